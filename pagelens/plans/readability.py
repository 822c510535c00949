"""Queries about what pages state and how they may be reached: types, normal forms, links, access, addresses."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.functions import addresses, events, links, normalize, urls
from pagelens.operators import access, page_facts, page_types, pages
from pagelens.plans.literal import case, table, values
from pagelens.plans.pages import _DECODE
from pagelens.plans.requests import REQUESTS_SQL, detected
from pagelens.sources.shared import read_table


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.tokenize(read_table(spark, sf_dir, "pages").select("page_id", "html"))


def page_metas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.metas(_nodes(spark, sf_dir)).select("page_id", "charset", "offset")


def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normal titles of pages, with a site's name put behind some."""
    own = pages.outline(_nodes(spark, sf_dir)).select("page_id", "title")
    suffix = F.element_at(F.array(*map(F.lit, SUFFIXES)), (F.col("page_id") % len(SUFFIXES) + 1).cast("int"))
    return own.select("page_id", normalize.title(F.concat("title", suffix)).alias("title"))


SUFFIXES = [" | Shop", " — Shop · Lamps", "", " :: Shop » Home", " - Shop"]
# Kinds and values as pages write them, and their normal forms in SQL; {n} is a supplier's name, {k} its key, {d} a day, {m} a number of minutes.
STATED = [
    ("availability", "https://schema.org/InStock", "'instock'"), ("availability", "Sold\u00a0out", "'outofstock'"), ("availability", "soon", "NULL"), ("phone", "+1 (415) 555-{k}", "CASE WHEN length(k) <= 8 THEN '+1415555' || k END"), ("phone", "{k}", "CASE WHEN length(k) BETWEEN 7 AND 15 THEN k END"),
    ("published", "\u3000{d} March 2024", "'2024-03-' || lpad(d, 2, '0')"), ("published", "2024/03/09", "'2024-03-09'"), ("updated", "Mar {d}, 2024", "'2024-03-' || lpad(d, 2, '0')"), ("updated", "yesterday", "NULL"), ("duration", "PT1H{m}M", "(60 + m::INT)::VARCHAR"), ("duration", "{m}\u00a0min read", "nullif(m, '0')"),
    ("duration", "2 hours", "'120'"), ("email", "mailto:S{k}@B.example", "'s' || k || '@b.example'"), ("email", "a b", "NULL"), ("currency", " eur", "'EUR'"), ("currency", "euro", "NULL"), ("item-count", "1,2{d} items", "'12' || d"), ("item-count", "none", "NULL"),
    ("title", "\u00a0{n}\u2003 Lamp\u00a0| Shop | Home", "lower(n) || ' lamp'"), ("title", "{n} — x", "lower(n)"), ("shipping", "free", "'declared'"), ("price", "Price on request", "'unpriced'"), ("brand", "\u00a0 {n}  Corp ", "lower(n) || ' corp'"), ("sku", "\u00a0", "NULL"),
]


def stated_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normal forms of values that suppliers state of themselves."""
    own = {"{n}": F.col("s_name"), "{k}": F.col("s_suppkey").cast("string"), "{d}": (F.col("s_suppkey") % 28 + 1).cast("string"), "{m}": (F.col("s_suppkey") % 60).cast("string")}
    forms = F.explode(F.array(*[F.struct(F.lit(i).alias("form"), F.lit(kind).alias("kind"), F.lit(value).alias("value")) for i, (kind, value, _) in enumerate(STATED)])).alias("f")
    rows = read_table(spark, sf_dir, "supplier").select("*", forms).select("s_suppkey", "f.form", "f.kind", reduce(lambda v, x: F.replace(v, F.lit(x[0]), x[1]), own.items(), F.col("f.value")).alias("value"))
    none = F.lit(None).cast("string")
    return rows.select("s_suppkey", "form", "kind", normalize.fact(F.col("kind"), F.col("value"), none, none).alias("normal"))


def labelled_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often lines `label: value` state a fact of which kind."""
    own = read_table(spark, sf_dir, "documents").select("text").unionByName(table(spark, "text string", [(x,) for x in LABELLED]))
    found = own.select(F.explode(page_facts.labelled_lines(F.col("text"))).alias("l")).select("l.kind", "l.label")
    return found.groupBy("kind", "label").agg(F.count("*").alias("lines"))


# Lines with labels, beside those of the documents.
LABELLED = ["**Price:** 12 EUR", "- Stock: in stock", "> Return policy: 30 days", "Author : Ann", "Delivery:", "plain text: not a label at all that is known", "Tel: 5", "a very long label that has more than thirty-two characters: x", "Item number:`A-1`"]
_LEXICON = list(page_facts.LABELS.items())


# Links as pages write them.
HREFS = ["a b.html?q=x y", "https://z.example:443/é", "a.html", "../b", "./c/./d", "/e/../f", "?q=1", "#top", "//cdn.example/x", "HTTPS://Y.example", "mailto:a@b.example", "../../../g/", ""]


def resolved_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of each page against its URL."""
    href = F.element_at(F.array(*map(F.lit, HREFS)), (F.col("page_id") % len(HREFS) + 1).cast("int"))
    return read_table(spark, sf_dir, "pages").select("page_id", href.alias("href"), links.absolute(href, F.col("url")).alias("target"))


# What pages say of their types: JSON-LD blocks, elements and paths, by the remainder of a part's key.
BLOCKS = ['{"@type": "https://schema.org/Product", "name": "x", "offers": {"@type": "Offer", "price": 3}}', '[{"@type": ["Thing", "FAQPage"]}, {"@type": "Store"}]', "{not json", '{"@graph": [{"@type": "WebPage"}]}', None]
MARKUP = [None, "http://schema.org/Restaurant https://schema.org/Thing", None]
PATHS = ["/en/products/4", "/help", "/x", "/docs/api/2"]


def page_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of pages made of parts, by JSON-LD, microdata, Open Graph and path."""
    k = F.col("p_partkey")
    pick = lambda items: F.element_at(F.array(*map(F.lit, items)), (k % len(items) + 1).cast("int"))
    block = F.when(pick(BLOCKS).isNotNull(), F.concat(F.lit('<script type="application/ld+json">'), pick(BLOCKS), F.lit("</script>"))).otherwise("")
    items = F.when(pick(MARKUP).isNotNull(), F.concat(F.lit('<div itemtype="'), pick(MARKUP), F.lit('">x</div>'))).otherwise("")
    og = F.when(k % 7 == 0, '<meta property="og:type" content=" Blog ">').otherwise("")
    made = read_table(spark, sf_dir, "part").select(k.cast("long").alias("page_id"), F.concat(block, items, og).alias("html"), pick(PATHS).alias("path"), (k % 11 == 0).alias("hours_and_phone"))
    nodes = pages.tokenize(made)
    signals = page_types.type_signals(page_types.json_ld_nodes(pages.json_ld_blocks(nodes)), nodes.where("type = 'element'"))
    return page_types.classify(made.select("page_id", "path", "hours_and_phone"), signals).groupBy("kind", "confidence", "signal", "recognised").agg(F.count("*").alias("pages"))


POLICY = [(0, "Claude", "deny", None, None), (1, " * ", "limit", 3, 60), (2, "claude", "allow", None, None), (3, "unverified", "limit", 0, 5), (4, "perplexity", "allow", None, None), (5, "", "deny", None, None), (6, "bingbot", "forbid", None, None)]
_POLICY_SCHEMA = "ordinal int, subject string, action string, requests int, window_seconds int"


def access_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which rules of a policy count, with and without verification."""
    rules = table(spark, _POLICY_SCHEMA, POLICY)
    both = [access.compile_rules(rules, v).select(F.lit(v).alias("verification"), "ordinal", "name", F.col("rejected").isNull().alias("counts")) for v in (True, False)]
    return both[0].unionByName(both[1])


def access_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions of that policy about all requests; those with an even key count as verified, and limited ones with a key divisible by 3 have no room left."""
    rules = access.compile_rules(table(spark, _POLICY_SCHEMA, POLICY), True)
    rows = detected(spark, sf_dir).select("event_id", "d.kind", "d.platform", (F.col("event_id") % 2 == 0).alias("verified"))
    matched = access.subject_of(rows, rules, F.col("kind"), F.col("platform"), F.col("verified"), F.lit(False))
    return access.decide(matched, "allow", F.col("event_id") % 3 != 0).select("event_id", "matched", "allowed", "reason")


SUBNETS = ["::ffff:{0}", "64:ff9b::{0}", "[fe80::{1}%eth0]", "2002:{1}:{1}::", "2001:db8::{1}", "fd00::{1}:1", "2a00:{1}::7", "::{0}", "1:2:3:{1}", "{0}", "300.{0}", "not-an-address"]


def address_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of IPv4 and IPv6 literals made of events."""
    n = F.col("event_id") * 429_496 % 4_294_967_296
    quad = F.concat_ws(".", *[F.expr(f"cast(event_id * 429496 % 4294967296 div {256**i} % 256 as string)") for i in (3, 2, 1, 0)])
    form = F.element_at(F.array(*map(F.lit, SUBNETS)), (F.col("event_id") % len(SUBNETS) + 1).cast("int"))
    text = F.replace(F.replace(form, F.lit("{0}"), quad), F.lit("{1}"), F.lower(F.hex(n % 65_521 + 1)))
    own = read_table(spark, sf_dir, "events").select(addresses.address(text).alias("a")).select("a.*")
    return own.groupBy("family", "reserved", "label").agg(F.count("*").alias("addresses"))


DOMAINS = ["x.example.com", "shop.example", "localhost", "a-.com", "UPPER.com", "10.0.0.1", "ok.co", "a..b", "_x.com"]


def public_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts of pages and some others that a capability may name."""
    hosts = read_table(spark, sf_dir, "pages").select(urls.host(F.col("url")).alias("domain")).unionByName(table(spark, "domain string", [(d,) for d in DOMAINS]))
    return hosts.groupBy("domain", events.is_public_domain(F.col("domain")).alias("public")).agg(F.count("*").alias("n"))


_STATED_SQL = "WITH s AS (SELECT s_suppkey, s_name AS n, s_suppkey::VARCHAR AS k, (s_suppkey % 28 + 1)::VARCHAR AS d, (s_suppkey % 60)::VARCHAR AS m FROM supplier) " + " UNION ALL ".join(f"SELECT s_suppkey, {i} AS form, '{kind}' AS kind, {normal} AS normal FROM s" for i, (kind, _, normal) in enumerate(STATED))
_UP = "regexp_replace({0}, '[^/]+/$', '')"
_TARGETS = [
    "origin || folder || 'a%20b.html?q=x%20y'", "'https://z.example/%C3%A9'", "origin || folder || 'a.html'", f"origin || {_UP.format('folder')} || 'b'", "origin || folder || 'c/d'", "origin || '/f'", "origin || path || '?q=1'", "origin || path || query || '#top'", "regexp_extract(origin, '^([a-z]+:)', 1) || '//cdn.example/x'", "'https://y.example/'",
    "'mailto:a@b.example'", f"origin || {_UP.format(_UP.format(_UP.format('folder')))} || 'g/'", "origin || path || query",
]
_LINKS_SQL = f"""WITH b AS (SELECT page_id, [{", ".join(f"'{h}'" for h in HREFS)}][(page_id % {len(HREFS)} + 1)::INT] AS href, lower(regexp_extract(url, '^([a-z]+://[^/?#]*)', 1)) AS origin, coalesce(nullif(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), ''), '/') AS path, regexp_extract(url, '^[^?#]*([?][^#]*)', 1) AS query FROM pages),
f AS (SELECT *, regexp_extract(path, '^(.*/)', 1) AS folder FROM b) SELECT page_id, href, CASE page_id % {len(HREFS)} {" ".join(f"WHEN {i} THEN {t}" for i, t in enumerate(_TARGETS))} END AS target FROM f"""
_V4_SQL = addresses.v4_label_sql
_ADDRESS_FORMS = [
    ("6", "v4 <> 'public'", "'IPv4-mapped → ' || v4"), ("6", "v4 <> 'public'", "'NAT64 64:ff9b::/96 → ' || v4"), ("6", "true", "'link-local (fe80::/10)'"), ("6", f"{_V4_SQL('x * 65537')} <> 'public'", f"'6to4 2002::/16 → ' || {_V4_SQL('x * 65537')}"),
    ("6", "true", "'documentation (2001:db8::/32)'"), ("6", "true", "'unique local (fc00::/7)'"), ("6", "false", "'public'"), ("6", "true", "'IPv4-compatible → ' || v4"), ("6", "true", "'unparseable IPv6 literal'"), ("4", "v4 <> 'public'", "v4"), ("4", "true", "'unparseable IPv4 literal'"),
    ("NULL", "NULL", "NULL"),
]
_ADDRESS_SQL = f"""WITH a AS (SELECT event_id % {len(SUBNETS)} AS form, event_id * 429496 % 4294967296 AS n FROM events), b AS (SELECT form, n % 65521 + 1 AS x, {_V4_SQL('n')} AS v4 FROM a),
c AS (SELECT {", ".join("CASE form " + " ".join(f"WHEN {i} THEN {f[j]}" for i, f in enumerate(_ADDRESS_FORMS)) + f" END AS {name}" for j, name in enumerate(("family", "reserved", "label")))} FROM b) SELECT family, reserved, label, count(*) AS addresses FROM c GROUP BY 1, 2, 3"""
_TITLE = "regexp_replace(trim(regexp_replace({0}, '\\s+', ' ', 'g')), '^(.+?)( \\| | — | – | · | :: | » ).*$', '\\1')"
_LD = {0: ("product", "json-ld @type Product", True), 1: ("faq", "json-ld @type FAQPage", True)}
_SEGMENT = {"/en/products/4": ("product", "products"), "/help": ("faq", "help"), "/docs/api/2": ("document", "docs")}
_KINDS_SQL = f"""WITH m AS (SELECT p_partkey AS k, p_partkey % {len(BLOCKS)} AS b, p_partkey % {len(MARKUP)} AS i, [{", ".join(f"'{p}'" for p in PATHS)}][(p_partkey % {len(PATHS)} + 1)::INT] AS path FROM part),
c AS (SELECT *, CASE WHEN b = 0 THEN 'product' WHEN b = 1 THEN 'faq' WHEN i = 1 THEN 'place' WHEN k % 7 = 0 THEN 'article' ELSE {case("path", [(p, x[0]) for p, x in _SEGMENT.items()], "{v} = '{k}'")} END AS by_signal,
  CASE WHEN b = 0 THEN 'json-ld @type Product' WHEN b = 1 THEN 'json-ld @type FAQPage' WHEN i = 1 THEN 'microdata itemtype Restaurant' WHEN k % 7 = 0 THEN 'og:type blog' ELSE {case("path", [(p, f"url path segment /{x[1]}/") for p, x in _SEGMENT.items()], "{v} = '{k}'")} END AS named FROM m)
SELECT coalesce(by_signal, CASE WHEN k % 11 = 0 THEN 'place' ELSE 'unknown' END) AS kind, CASE WHEN b < 2 OR i = 1 THEN 'high' WHEN by_signal IS NOT NULL OR k % 11 = 0 THEN 'medium' ELSE 'low' END AS confidence,
  coalesce(named, CASE WHEN k % 11 = 0 THEN 'opening hours and telephone' ELSE 'no classifying signal' END) AS signal, b IN (0, 1, 3) OR i = 1 AS recognised, count(*) AS pages FROM c GROUP BY 1, 2, 3, 4"""
_ACCESS_SQL = f"""WITH {REQUESTS_SQL}, m AS (SELECT event_id, kind, CASE WHEN kind = 'agent' THEN CASE WHEN event_id % 2 = 0 AND platform IN ('claude', 'perplexity') THEN platform ELSE '*' END END AS matched FROM detected)
SELECT event_id, matched, NOT (coalesce(matched = 'claude', false) OR coalesce(matched = '*', false) AND event_id % 3 = 0) AS allowed, CASE WHEN matched = 'claude' THEN 'denied' WHEN matched = '*' AND event_id % 3 = 0 THEN 'rate-limited' END AS reason FROM m"""
_RULES_SQL = values("r", "verification, ordinal, name, counts", [(v, o, n, c) for v in (True, False) for o, n, c in [(0, "claude", v), (1, "*", True), (2, "claude", False), (3, "unverified", False), (4, "perplexity", v), (5, "", False), (6, "bingbot", False)]])
_LABEL_SQL = f"""WITH {values("own", "line", [(x,) for x in LABELLED])}, {values("lexicon", "label, kind", _LEXICON)}, lines AS (SELECT unnest(string_split(text, chr(10))) AS line FROM documents UNION ALL SELECT line FROM own),
s AS (SELECT left(line, instr(line, ':') - 1) AS label, substring(line, instr(line, ':') + 1) AS value FROM lines WHERE instr(line, ':') BETWEEN 1 AND 33),
n AS (SELECT lower(trim(regexp_replace(regexp_replace(label, '^[\\s>*\\-+#]+', ''), '[*_`]', '', 'g'))) AS label, trim(regexp_replace(value, '^[\\s*_`]+', '')) AS value FROM s) SELECT kind, label, count(*) AS lines FROM n JOIN lexicon USING (label) WHERE value <> '' GROUP BY 1, 2"""
_DOMAIN_SQL = f"""WITH {values("own", "domain", [(d,) for d in DOMAINS])}, h AS (SELECT nullif(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '') AS domain FROM pages UNION ALL SELECT domain FROM own)
SELECT domain, coalesce(length(domain) <= 253 AND NOT regexp_matches(domain, '^[0-9.]+$') AND NOT regexp_matches(domain, '(^|\\.)(localhost|local|internal|test|invalid|example)$') AND contains(domain, '.') AND len(list_filter(string_split(domain, '.'), lambda x: NOT regexp_matches(x, '^[a-z0-9]([a-z0-9-]{{0,61}}[a-z0-9])?$'))) = 0, false) AS public, count(*) AS n FROM h GROUP BY 1, 2"""
QUERIES = {
    "page_metas": (page_metas, "SELECT page_id, lower(regexp_extract(html, '<meta charset=\"([^\"]*)\"', 1)) AS charset, octet_length(encode(left(html, instr(html, '<meta charset') - 1))) AS \"offset\" FROM pages WHERE contains(html, '<meta charset')"),
    "page_titles": (page_titles, f"SELECT page_id, lower(trim({_TITLE.format('t')})) AS title FROM (SELECT page_id, regexp_replace({_DECODE.format("regexp_extract(html, '<title>(.*?)</title>', 1)")}, '\\s+', ' ', 'g') || [{', '.join(chr(39) + s + chr(39) for s in SUFFIXES)}][(page_id % {len(SUFFIXES)} + 1)::INT] AS t FROM pages)"),
    "labelled_facts": (labelled_facts, _LABEL_SQL),
    "stated_values": (stated_values, _STATED_SQL),
    "resolved_links": (resolved_links, _LINKS_SQL),
    "page_kinds": (page_kinds, _KINDS_SQL),
    "access_rules": (access_rules, f"WITH {_RULES_SQL} SELECT * FROM r"),
    "access_decisions": (access_decisions, _ACCESS_SQL),
    "address_labels": (address_labels, _ADDRESS_SQL),
    "public_domains": (public_domains, _DOMAIN_SQL),
}
