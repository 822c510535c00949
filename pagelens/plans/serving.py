"""Queries about serving: limits, robots decisions, addresses, evaluations, money and rendered records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagelens.functions import addresses, money, urls, validate
from pagelens.operators import evaluation, limiter, robots
from pagelens.plans.literal import table, values
from pagelens.sources.shared import read_table

LIMIT, WINDOW_S = 5, 86_400


def request_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = limiter.limit_requests(read_table(spark, sf_dir, "events"), LIMIT, WINDOW_S)
    return out.select(F.col("id").alias("event_id"), F.col("subject").cast("long").alias("user_id"), "allowed")


ROBOTS = [
    (0, "User-agent: *\nDisallow: /en/1\nAllow: /en/12\nSitemap: https://x.example/s.xml\n\nUser-agent: GPTBot\nUser-agent: ClaudeBot # two\nDisallow: /\nAllow: /*.html$\nnonsense\n"),
    (1, "Disallow: /early\nuser-agent: claudebot\ndisallow:\nallow: /fr\ndisallow: /fr/\nCrawl-delay: 3\n"),
    (2, "User-agent: GPTBot\nDisallow: /*/2*7\nDisallow: /en/4?5$\nallow: /en/\n: empty\nUser-agent: *\nDisallow: /de"),
    (3, "# nothing here\n"),
]
TOKENS = ["GPTBot", "ClaudeBot", "OtherBot"]


def _robots(spark: SparkSession) -> DataFrame:
    return robots.parse(table(spark, "file int, body string", ROBOTS))


def robots_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", urls.path(F.col("url")).alias("path"))
    files = F.explode(F.sequence(F.lit(0), F.lit(len(ROBOTS) - 1))).alias("file")
    asked = pages.select("page_id", "path", files).select("*", F.explode(F.array(*map(F.lit, TOKENS))).alias("token"))
    asked = asked.withColumn("request", F.concat_ws("/", "page_id", "file", "token"))
    return robots.decide(_robots(spark), asked.select("request", "file", "token", "path"))


def robots_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups, lines and sitemaps of the robots file of each page's host; one of those above, with a sitemap of the host's own put before it."""
    k = F.col("page_id") % len(ROBOTS)
    body = F.concat(F.lit("Sitemap: https://x.example/"), F.col("page_id").cast("string"), F.lit(".xml\n"), F.element_at(F.array(*[F.lit(b) for _, b in ROBOTS]), (k + 1).cast("int")))
    parsed = robots.parse(read_table(spark, sf_dir, "pages").select(F.col("page_id").alias("file"), body.alias("body")))
    return parsed.groupBy("file").agg(F.max("group").alias("groups"), F.count_if("malformed").alias("malformed"), F.count_if("orphan").alias("orphans"), F.count_if(F.col("field") == "sitemap").alias("sitemaps"))


def address_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of IPv4 addresses derived from events, by first match over ordered ranges."""
    quad = F.concat_ws(".", *[F.expr(f"cast(event_id * 429496 % 4294967296 div {256**i} % 256 as string)") for i in (3, 2, 1, 0)])
    return read_table(spark, sf_dir, "events").select(addresses.address(quad)["label"].alias("label")).groupBy("label").agg(F.count("*").alias("addresses"))


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    profiles = F.explode(F.array(*[F.struct(F.lit(i).alias("p"), F.lit(n).alias("profile")) for i, n in enumerate(("baseline", "source-envelope", "section-index"))])).alias("x")
    parts = read_table(spark, sf_dir, "part").select(F.col("p_partkey").alias("case"), "p_size", profiles).select("case", "p_size", "x.*")
    model, repetition = F.concat(F.lit("m"), (F.col("case") % 2).cast("string")), (F.col("case") % 4 / 2).cast("int")
    correct = F.least(F.lit(9), F.col("p_size") % 9 + F.when(F.col("p") == 1, F.col("case") % 3).when((F.col("p") == 2) & (F.col("p_size") == 50), -1).otherwise(0))
    return parts.select(
        "case", "profile", F.col("profile").alias("actual"), model.alias("model"), repetition.alias("repetition"), F.when(F.col("case") % 3 == 0, "holdout").otherwise("development").alias("split"),
        correct.cast("int").alias("correct"), F.lit(10).alias("total"), (F.col("p_size") % 4).alias("qualified"), F.lit(4).alias("qualifications"), F.lit(True).alias("fidelity"), F.lit(None).cast("string").alias("error"),
    )


def evaluation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.summarize(_results(spark, sf_dir))


def promotable_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.promotable(_results(spark, sf_dir))


CODES = ["USD", "EUR", "jpy", "KWD", "CHF"]


def _priced(spark: SparkSession, sf_dir: str) -> DataFrame:
    amount = (F.round(F.col("p_retailprice") * 100) * F.when(F.col("p_partkey") % 7 == 0, -1).otherwise(1)).cast("long")
    code = F.element_at(F.array(*map(F.lit, CODES)), (F.col("p_partkey") % len(CODES) + 1).cast("int"))
    return read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", amount.alias("amount"), code.alias("currency"))


def formatted_money(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, c = F.col("amount"), F.col("currency")
    return _priced(spark, sf_dir).select("p_partkey", money.format_money(a, c).alias("shown"), money.decimal_string(a, c).alias("decimal"))


BUDGET = 900
NOTE = "_(truncated)_"


def catalog_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Markdown table for each brand: rows in order while they fit the byte budget, with a note if any was left out.

    The running size is a window sum, so only rows that fit are gathered.
    """
    cell = F.regexp_replace(F.regexp_replace("p_name", r"\s*\r?\n\s*", " "), r"([\[\]|])", r"\\$1")
    line = F.concat(F.lit("| "), cell, F.lit(" | "), money.format_money(F.col("amount"), F.col("currency")), F.lit(" | In stock |"))
    head = "# Catalog\n\n| Title | Price | Availability |\n| --- | --- | --- |"
    by = Window.partitionBy("p_brand").orderBy("p_partkey")
    rows = _priced(spark, sf_dir).select("p_brand", "p_partkey", line.alias("line"))
    sized = rows.withColumn("size", len(head) + F.sum(F.octet_length("line") + 1).over(by)).withColumn("all", F.sum(F.octet_length("line") + 1).over(Window.partitionBy("p_brand")) + len(head))
    fits = F.when(F.col("all") <= BUDGET, True).otherwise(F.col("size") <= BUDGET - len(NOTE) - 2)
    out = sized.groupBy("p_brand").agg(F.array_sort(F.collect_list(F.when(fits, F.struct("p_partkey", "line")))).alias("l"), F.count("*").alias("items"))
    body = F.array_join(F.transform("l", lambda x: F.concat(F.lit("\n"), x["line"])), "")
    return out.select("p_brand", F.concat(F.lit(head), body, F.when(F.size("l") < F.col("items"), f"\n\n{NOTE}").otherwise("")).alias("markdown"), F.size("l").alias("shown"), "items")


def product_json_ld(spark: SparkSession, sf_dir: str) -> DataFrame:
    """schema.org objects of products, keys in a fixed order."""
    a, c = F.col("amount"), F.col("currency")
    brand = F.struct(F.lit("Brand").alias("@type"), F.col("p_brand").alias("name"))
    offer = F.struct(F.lit("Offer").alias("@type"), money.decimal_string(a, c).alias("price"), c.alias("priceCurrency"), F.lit("https://schema.org/InStock").alias("availability"))
    item = F.struct(F.lit("https://schema.org").alias("@context"), F.lit("Product").alias("@type"), F.col("p_name").alias("name"), brand.alias("brand"), offer.alias("offers"))
    return _priced(spark, sf_dir).select("p_partkey", F.to_json(item).alias("json"))


def site_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index document for each nation: its suppliers as links with notes, in order of their keys; nations without one are left out."""
    line = F.concat(F.lit("- ["), F.col("s_name"), F.lit("](https://x.example/s/"), F.col("s_suppkey").cast("string"), F.lit("): "), money.format_money(F.round(F.col("s_acctbal") * 100).cast("long"), F.lit("USD")))
    rows = read_table(spark, sf_dir, "supplier").join(read_table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    out = rows.groupBy("n_name").agg(F.array_sort(F.collect_list(F.struct("s_suppkey", line.alias("line")))).alias("l"))
    lines = F.array_join(F.transform("l", lambda x: x["line"]), "\n")
    return out.select("n_name", F.concat(F.lit("# "), F.col("n_name"), F.lit("\n\n> Suppliers\n\n## Products\n\n"), lines, F.lit("\n")).alias("document"))


# The first problems of derived events, in the order of validation: SQL of when, and the message.
PROBLEMS = [
    ("k % 11 = 0", "missing required field 'event_id'"), ("k % 13 = 0", "missing required field 'ts'"), ("k % 17 = 0", "missing required field 'store_id'"), ("k % 4 = 2", "'requester.kind' is not a known kind"),
    ("k % 5 = 0", "missing required field 'requester.verified'"), ("k % 7 = 0", "missing required field 'request.url'"), ("k % 3 = 2", "'response.path' is not a known path"),
    ("k % 19 = 0 OR value IS NULL", "missing required field 'response.render_ms'"), ("k % 29 = 0", "'response.profile_id' must be a bounded profile identifier"), ("k % 31 = 0", "'response.profile_version' must be a positive integer"),
    ("k % 23 = 0", "'response.coverage' is not a known coverage"), ("k % 37 = 0", "'outcome.order_value_minor' requires nonnegative integer minor units and currency"), ("k % 6 = 0", "'outcome.currency' must be a three-letter uppercase currency code"),
]


def event_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many typed events, derived from events with fields left out or wrong, have which first problem."""
    k, none = F.col("event_id"), F.lit(None)
    pick = lambda items: F.element_at(F.array(*map(F.lit, items)), (k % len(items) + 1).cast("int"))
    rows = read_table(spark, sf_dir, "events").select(
        F.when(k % 11 != 0, k.cast("string")).alias("event_id"), F.when(k % 13 != 0, F.col("ts").cast("string")).alias("ts"), F.when(k % 17 != 0, "store").alias("store_id"),
        F.struct(pick(["agent", "human", "robot", "crawler"]).alias("kind"), none.cast("string").alias("platform"), F.when(k % 5 != 0, False).alias("verified")).alias("requester"),
        F.struct(F.when(k % 7 != 0, "https://x.example/").alias("url"), F.create_map().cast("map<string,string>").alias("intent_signals"), none.cast("string").alias("accept"), none.cast("string").alias("referrer")).alias("request"),
        F.struct(
            pick(["markdown", "denied", "html"]).alias("path"), none.cast("string").alias("variant_id"), F.when(k % 19 != 0, F.col("value").cast("double")).alias("render_ms"), none.cast("string").alias("source"),
            F.when(k % 23 == 0, "maybe").alias("coverage"), F.when(k % 29 == 0, "Bad Id").alias("profile_id"), F.when(k % 31 == 0, 0).cast("long").alias("profile_version"), none.cast("long").alias("compatibility_runtime"),
        ).alias("response"),
        F.struct(none.cast("boolean").alias("purchase"), F.when(k % 37 == 0, -1).cast("long").alias("order_value_minor"), F.when(k % 6 == 0, "usd").alias("currency"), none.cast("double").alias("order_value")).alias("outcome"),
    )
    return rows.groupBy(validate.first_problem().alias("problem")).agg(F.count("*").alias("events"))


def _arr(items: list[str]) -> str:
    return "[" + ", ".join(f"'{x}'" for x in items) + "]"


_SHOWN = {"{z}": ", ".join(f"'{c}'" for c in money.ZERO_DECIMAL), "{t}": ", ".join(f"'{c}'" for c in money.THREE_DECIMAL)}


def _money(amount: str, code: str) -> tuple[str, str]:
    """SQL of the shown and the decimal form of an amount."""
    digits = f"(CASE WHEN upper({code}) IN ({_SHOWN['{z}']}) THEN 0 WHEN upper({code}) IN ({_SHOWN['{t}']}) THEN 3 ELSE 2 END)"
    factor = f"(CASE {digits} WHEN 0 THEN 1 WHEN 3 THEN 1000 ELSE 100 END)"
    sign = f"(CASE WHEN {amount} < 0 THEN '-' ELSE '' END)"
    major = f"(abs({amount}) // {factor})"
    fraction = f"(CASE WHEN {digits} = 0 THEN '' ELSE '.' || lpad((abs({amount}) % {factor})::VARCHAR, {digits}, '0') END)"
    mark = "(CASE " + " ".join(f"WHEN upper({code}) = '{c}' THEN '{s}'" for c, s in money.SYMBOLS) + f" ELSE upper({code}) || ' ' END)"
    return f"{sign} || {mark} || format('{{:,}}', {major}) || {fraction}", f"{sign} || {major}::VARCHAR || {fraction}"


_PRICED = f"priced AS (SELECT p_partkey, p_name, p_brand, (round(p_retailprice * 100) * CASE WHEN p_partkey % 7 = 0 THEN -1 ELSE 1 END)::BIGINT AS amount, {_arr(CODES)}[(p_partkey % {len(CODES)} + 1)::INT] AS currency FROM part)"
_SHOW, _DECIMAL = _money("amount", "currency")
_RESULTS = """results AS (SELECT p_partkey AS "case", profile, 'm' || (p_partkey % 2)::VARCHAR AS model, (p_partkey % 4) // 2 AS repetition, CASE WHEN p_partkey % 3 = 0 THEN 'holdout' ELSE 'development' END AS split,
  least(9, p_size % 9 + CASE WHEN p = 1 THEN p_partkey % 3 WHEN p = 2 AND p_size = 50 THEN -1 ELSE 0 END)::INT AS correct, 10 AS total, p_size % 4 AS qualified, 4 AS qualifications
  FROM part CROSS JOIN (VALUES (0, 'baseline'), (1, 'source-envelope'), (2, 'section-index')) AS x(p, profile))"""
_ROBOT_RULES = """parsed AS (SELECT file, generate_subscripts(string_split_regex(body, '\\r?\\n'), 1) AS line, unnest(string_split_regex(body, '\\r?\\n')) AS raw FROM robots),
cleaned AS (SELECT file, line, trim(string_split(raw, '#')[1]) AS text FROM parsed WHERE trim(string_split(raw, '#')[1]) <> ''),
fields AS (SELECT file, line, CASE WHEN instr(text, ':') > 1 THEN lower(trim(left(text, instr(text, ':') - 1))) END AS field, trim(substring(text, instr(text, ':') + 1)) AS value FROM cleaned),
marked AS (SELECT *, last_value(CASE WHEN field IN ('user-agent', 'allow', 'disallow') THEN field END IGNORE NULLS) OVER (PARTITION BY file ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM fields),
grouped AS (SELECT *, nullif(sum(CASE WHEN field = 'user-agent' AND coalesce(last <> 'user-agent', true) THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY line ROWS UNBOUNDED PRECEDING), 0) AS grp FROM marked)"""
_ROBOTS = values("robots", "file, body", ROBOTS)
_PATH = "coalesce(nullif(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1), ''), '/')"
_PATTERN = r"'^' || replace(regexp_replace(regexp_replace(value, '\$$', ''), '([.\\+?()\[\]{}^$|])', '\\\1', 'g'), '*', '.*') || CASE WHEN ends_with(value, '$') THEN '$' ELSE '' END"
_HEAD = "'# Catalog' || chr(10) || chr(10) || '| Title | Price | Availability |' || chr(10) || '| --- | --- | --- |'"
_INDEX_PRICE = _money("(round(s_acctbal * 100)::BIGINT)", "'USD'")[0]
QUERIES = {
    "request_limits": (
        request_limits,
        f"""WITH RECURSIVE starts AS (SELECT user_id, min(ts) AS s FROM events GROUP BY 1 UNION ALL SELECT starts.user_id, min(e.ts) FROM starts JOIN events e ON e.user_id = starts.user_id AND e.ts >= starts.s + INTERVAL {WINDOW_S} SECOND GROUP BY starts.user_id, starts.s),
        placed AS (SELECT event_id, e.user_id, ts, max(s) AS s FROM events e JOIN starts ON starts.user_id = e.user_id AND starts.s <= e.ts GROUP BY 1, 2, 3)
        SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id, s ORDER BY ts, event_id) <= {LIMIT} AS allowed FROM placed""",
    ),
    "robots_decisions": (
        robots_decisions,
        f"""WITH {_ROBOTS}, {_ROBOT_RULES}, asked AS (SELECT page_id::VARCHAR || '/' || file::VARCHAR || '/' || token AS request, file, token, {_PATH} AS path FROM pages CROSS JOIN (SELECT DISTINCT file FROM robots) CROSS JOIN (SELECT unnest({_arr(TOKENS)}) AS token)),
        named AS (SELECT request, grp, lower(value) AS agent, row_number() OVER (PARTITION BY request ORDER BY CASE WHEN value = '*' THEN 0 ELSE -length(value) END, line) AS r FROM asked JOIN grouped g ON g.file = asked.file AND field = 'user-agent' AND (value = '*' OR lower(value) = lower(token))),
        best AS (SELECT * FROM named WHERE r = 1),
        hits AS (SELECT a.request, field, value, row_number() OVER (PARTITION BY a.request ORDER BY -length(value), field, value) AS r FROM asked a JOIN best USING (request) JOIN grouped g ON g.file = a.file AND g.grp = best.grp AND field IN ('allow', 'disallow') WHERE value <> '' AND regexp_matches(path, {_PATTERN}))
        SELECT a.request, CASE WHEN b.agent IS NULL THEN 'unspecified' ELSE coalesce(h.field, 'allow') END AS decision, b.agent AS matched_agent, upper(left(h.field, 1)) || substring(h.field, 2) || ': ' || h.value AS matched_rule FROM asked a LEFT JOIN best b ON b.request = a.request LEFT JOIN hits h ON h.request = a.request AND h.r = 1""",
    ),
    "robots_lines": (robots_lines, f"WITH {_ROBOTS}, {_ROBOT_RULES}, counted AS (SELECT file AS k, max(grp)::BIGINT AS groups, count(*) FILTER (coalesce(field NOT IN ('user-agent', 'allow', 'disallow', 'sitemap', 'crawl-delay', 'host', 'clean-param'), true)) AS malformed, count(*) FILTER (field IN ('allow', 'disallow') AND grp IS NULL) AS orphans, count(*) FILTER (field = 'sitemap') AS sitemaps FROM grouped GROUP BY 1) SELECT page_id AS file, groups, coalesce(malformed, 0) AS malformed, coalesce(orphans, 0) AS orphans, coalesce(sitemaps, 0) + 1 AS sitemaps FROM pages LEFT JOIN counted ON page_id % 4 = k"),
    "address_ranges": (address_ranges, f"SELECT {addresses.v4_label_sql('n')} AS label, count(*) AS addresses FROM (SELECT event_id * 429496 % 4294967296 AS n FROM events) GROUP BY 1"),
    "evaluation_summary": (evaluation_summary, f"WITH {_RESULTS} SELECT profile, split, count(*) AS runs, sum(correct)::BIGINT AS correct, sum(total)::BIGINT AS total, sum(qualified)::BIGINT AS qualified, sum(qualifications)::BIGINT AS qualifications, count(*) AS fidelity_passed, 0::BIGINT AS errors FROM results GROUP BY 1, 2"),
    "promotable_profiles": (
        promotable_profiles,
        f"""WITH {_RESULTS}, runs AS (SELECT c.profile, c.model, c.repetition, bool_and(c.correct >= b.correct AND c.qualified >= b.qualified) AS good, bool_or(c.split = 'holdout' AND c.correct > b.correct) AS lift
        FROM results c JOIN results b ON b.profile = 'baseline' AND b."case" = c."case" AND b.model = c.model AND b.repetition = c.repetition WHERE c.profile <> 'baseline' GROUP BY 1, 2, 3) SELECT profile, bool_and(good AND lift) AS promotable, count(*) AS model_runs FROM runs GROUP BY 1""",
    ),
    "formatted_money": (formatted_money, f'WITH {_PRICED} SELECT p_partkey, {_SHOW} AS shown, {_DECIMAL} AS "decimal" FROM priced'),
    "catalog_tables": (
        catalog_tables,
        f"""WITH {_PRICED}, lines AS (SELECT p_brand, p_partkey, '| ' || regexp_replace(regexp_replace(p_name, '\\s*\\r?\\n\\s*', ' ', 'g'), '([\\[\\]|])', '\\\\\\1', 'g') || ' | ' || {_SHOW} || ' | In stock |' AS line FROM priced),
        sized AS (SELECT *, length({_HEAD}) + sum(octet_length(encode(line)) + 1) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS size, length({_HEAD}) + sum(octet_length(encode(line)) + 1) OVER (PARTITION BY p_brand) AS full_size FROM lines),
        kept AS (SELECT *, full_size <= {BUDGET} OR size <= {BUDGET - len(NOTE) - 2} AS fits FROM sized)
        SELECT p_brand, {_HEAD} || coalesce(string_agg(chr(10) || line, '' ORDER BY p_partkey) FILTER (fits), '') || CASE WHEN count(*) FILTER (fits) < count(*) THEN chr(10) || chr(10) || '{NOTE}' ELSE '' END AS markdown, count(*) FILTER (fits) AS shown, count(*) AS items FROM kept GROUP BY 1""",
    ),
    "product_json_ld": (
        product_json_ld,
        f"""WITH {_PRICED} SELECT p_partkey, '{{"@context":"https://schema.org","@type":"Product","name":' || to_json(p_name)::VARCHAR || ',"brand":{{"@type":"Brand","name":' || to_json(p_brand)::VARCHAR || '}},"offers":{{"@type":"Offer","price":"' || {_DECIMAL} || '","priceCurrency":"' || currency || '","availability":"https://schema.org/InStock"}}}}' AS json FROM priced""",
    ),
    "site_index": (site_index, f"SELECT n_name, '# ' || n_name || chr(10) || chr(10) || '> Suppliers' || chr(10) || chr(10) || '## Products' || chr(10) || chr(10) || string_agg('- [' || s_name || '](https://x.example/s/' || s_suppkey::VARCHAR || '): ' || {_INDEX_PRICE}, chr(10) ORDER BY s_suppkey) || chr(10) AS document FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1"),
    "event_problems": (event_problems, "SELECT " + "CASE " + " ".join(f"WHEN {c} THEN '" + m.replace("'", "''") + "'" for c, m in PROBLEMS) + " END AS problem, count(*) AS events FROM (SELECT event_id AS k, value FROM events) GROUP BY 1"),
}
