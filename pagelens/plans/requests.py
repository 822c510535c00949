"""Queries over requests derived from events, pages and a literal dimension of clients."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.functions import intent, requests, urls
from pagelens.plans.literal import case, table, values
from pagelens.sources.shared import read_table

# Clients: user agent, Accept, Signature-Agent, whether signed, path suffix, referrer.
CLIENTS = [
    ("Mozilla/5.0 (compatible; Googlebot/2.1)", "text/markdown", None, False, "", "https://www.google.com/"),
    ("Mozilla/5.0 (Windows NT 10.0) Chrome/126", "text/html,application/xhtml+xml;q=0.9", None, False, "", None),
    ("ChatGPT-User/1.0", "text/markdown, text/html;q=0.8", '"https://chatgpt.com"', True, "", "https://chatgpt.com/c/1"),
    ("ClaudeBot/1.0", "*/*", None, False, "", "https://claude.ai/chat"),
    ("curl/8.5.0", "*/*", None, False, "", None),
    ("python-requests/2.32", "text/markdown;q=0", None, False, "/mcp/", None),
    ("SomeAgent/2", "text/html;q=0.5, text/markdown;q=0.9", '"https://agents.openai.com", "x"', False, "", "chat.openai.com"),
    ("SomeAgent/2", "application/json", None, True, "", "perplexity.ai"),
    ("PerplexityBot/1.0 claude-user", "text/html", None, False, "", "https://www.perplexity.ai/search?q=x"),
    ("AppleWebKit Applebot/0.1", "text/html", None, False, "", None),
    ("Mozilla/5.0 AppleWebKit Amazonbot/0.1", "text/html", None, False, "", "https://gemini.google.com/app"),
    ("", None, None, False, "/.well-known/ucp", None),
    ("meta-externalagent/1.1", "text/markdown; q=", None, False, "", "https://x.ai"),
    ("adidxbot/2.0", "TEXT/MARKDOWN", None, False, "", None),
    ("Agent", "text/html", "gemini.google.com", False, "", "not a host!"),
    ("Agent", "text/html", '""', False, "/acp/feed", "https://you.com/search"),
    ("Mozilla/5.0 Safari", "image/png", None, False, "", "https://evil-claude.ai/"),
    ("MistralAI-User/1.0", "text/markdown;level=1;q=0.3", None, False, "", "chat.mistral.ai"),
]
_ROWS = [(i, *c) for i, c in enumerate(CLIENTS)]
_SCHEMA = "client int, agent string, accept string, signer string, signed boolean, suffix string, referrer string"


def derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request for each event: event_id, ts, user_id, agent, accept, referrer, url, headers."""
    events = read_table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    pages = read_table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("page_url"))
    n = pages.agg(F.count("*").alias("n"))
    clients = F.broadcast(table(spark, _SCHEMA, _ROWS))  # a fixed number of rows
    keyed = events.crossJoin(F.broadcast(n)).withColumn("page_id", F.col("event_id") % F.col("n")).withColumn("client", (F.col("event_id") % len(_ROWS)).cast("int"))
    joined = keyed.join(pages, "page_id").join(clients, "client")
    url = F.concat(F.regexp_extract("page_url", r"^([a-z]+://[^/?#]*)", 1), F.when(F.col("suffix") == "", F.regexp_extract("page_url", r"^[a-z]+://[^/?#]*(.*)$", 1)).otherwise(F.col("suffix")))
    one = lambda name, value: F.struct(F.lit(name), F.when(value.isNotNull(), F.array(value)))
    signature = F.when(F.col("signed"), F.lit("sig1=:AA==:"))
    headers = F.map_from_entries(F.array(
        one("User-Agent", F.col("agent")), one("ACCEPT", F.col("accept")), one("Signature-Agent", F.col("signer")), one("signature", signature), one("Signature-Input", signature),
    ))
    return joined.select("event_id", "ts", "user_id", "event_type", "agent", "accept", "referrer", url.alias("url"), headers.alias("headers"))


_HOST = r"nullif(regexp_extract(lower({0}), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '')"
_PATH = r"coalesce(nullif(regexp_extract({0}, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1), ''), '/')"
_Q = (
    r"list_filter(list_transform(list_filter(string_split(accept, ','), lambda p: trim(string_split(p, ';')[1]) <> ''), lambda p: {{'t': lower(trim(string_split(p, ';')[1])), "
    r"'q': coalesce(list_transform(list_filter(string_split(p, ';'), lambda s: regexp_matches(lower(s), '^\s*q\s*=')), lambda s: CASE WHEN trim(regexp_extract(s, '=(.*)', 1)) = '' THEN 0.0::DOUBLE ELSE try_cast(trim(regexp_extract(s, '=(.*)', 1)) AS DOUBLE) END)[-1], 1.0)}}), lambda r: r.t = '{0}' AND r.q > 0)"
)
REQUESTS_SQL = f"""{values("clients", "client, agent, accept, signer, signed, suffix, referrer", _ROWS)},
requests AS (
  SELECT event_id, ts, user_id, event_type, agent, accept, signer, signed, referrer,
    regexp_extract(p.url, '^([a-z]+://[^/?#]*)', 1) || CASE WHEN suffix = '' THEN regexp_extract(p.url, '^[a-z]+://[^/?#]*(.*)$', 1) ELSE suffix END AS url
  FROM events e JOIN pages p ON p.page_id = e.event_id % (SELECT count(*) FROM pages) JOIN clients c ON c.client = e.event_id % {len(_ROWS)}
), evidence AS (
  SELECT *, lower(coalesce(agent, '')) AS ua,
    coalesce(len({_Q.format("text/markdown")}), 0) > 0 AS md, coalesce(len({_Q.format("text/html")}), 0) > 0 AS html,
    nullif(trim(regexp_replace(regexp_replace(trim(string_split(signer, ',')[1]), '^"', ''), '"$', '')), '') AS bare,
    regexp_replace(lower({_PATH.format("url")}), '/+$', '') AS own_path
  FROM requests
), named AS (
  SELECT *, coalesce({_HOST.format("bare")}, lower(bare)) AS signer_host,
    {case("own_path", [(r, r) for r in requests.PROTOCOL_ROUTES], "({v} = '{k}' OR starts_with({v}, '{k}/'))")} AS route,
    {case("ua", [(p, p) for p, _ in requests.CRAWLER_AGENTS], "contains({v}, '{k}')")} AS crawler,
    {case("ua", requests.CRAWLER_AGENTS, "contains({v}, '{k}')")} AS crawler_platform
  FROM evidence
), known AS (
  SELECT *, CASE WHEN crawler IS NULL THEN {case("ua", [(p, p) for p, _ in requests.AGENT_AGENTS], "contains({v}, '{k}')")} END AS bot,
    CASE WHEN crawler IS NULL THEN {case("ua", requests.AGENT_AGENTS, "contains({v}, '{k}')")} END AS bot_platform,
    CASE WHEN signer_host IS NOT NULL THEN coalesce({case("signer_host", requests.SIGNATURE_DOMAINS, "({v} = '{k}' OR ends_with({v}, '.{k}'))")}, 'unknown') END AS signer_platform
  FROM named
), detected AS (
  SELECT event_id, ts, user_id, event_type, url, referrer, md,
    CASE WHEN crawler IS NOT NULL THEN 'crawler' WHEN md OR signer_host IS NOT NULL OR signed THEN 'agent' WHEN route IS NOT NULL THEN 'protocol' WHEN bot IS NOT NULL THEN 'agent' ELSE 'human' END AS kind,
    CASE WHEN crawler IS NOT NULL THEN crawler_platform WHEN md OR signer_host IS NOT NULL OR signed THEN coalesce(signer_platform, bot_platform, 'unknown') ELSE bot_platform END AS platform,
    CASE WHEN crawler IS NOT NULL THEN 'medium' WHEN md OR signer_host IS NOT NULL THEN 'high' WHEN signed THEN 'medium' WHEN route IS NOT NULL THEN 'high' WHEN bot IS NOT NULL THEN 'medium' WHEN html OR contains(ua, 'mozilla/') THEN 'high' ELSE 'low' END AS confidence,
    route,
    concat_ws('|', CASE WHEN md THEN 'accept:text/markdown' END, 'signature-agent:' || signer_host, CASE WHEN signed THEN 'web-bot-auth:signature' END, 'protocol:' || route, 'ua:' || crawler, 'ua:' || bot,
      CASE WHEN crawler IS NULL AND NOT md AND signer_host IS NULL AND NOT signed AND route IS NULL AND bot IS NULL THEN CASE WHEN html THEN 'accept:text/html' WHEN contains(ua, 'mozilla/') THEN 'ua:browser' END END) AS signals
  FROM known
)"""


def detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests.detect(derived(spark, sf_dir), out="d")


def request_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detected(spark, sf_dir).select(
        "event_id", "d.kind", "d.platform", "d.confidence", "d.verified", F.col("d.accepts_markdown").alias("accepts_markdown"), F.array_join("d.signals", "|").alias("signals")
    )


def serving_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = detected(spark, sf_dir).withColumn("path", requests.serving_path(F.col("d")))
    return rows.groupBy("d.kind", "path").agg(F.count("*").alias("requests"), F.count_distinct("user_id").alias("users"))


def kind_platform_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = detected(spark, sf_dir).select("d.kind", F.coalesce("d.platform", F.lit("none")).alias("platform"))
    out = rows.cube("kind", "platform").agg(F.count("*").alias("requests"))
    return out.select(F.coalesce("kind", F.lit("*")).alias("kind"), F.coalesce("platform", F.lit("*")).alias("platform"), "requests")


def referrers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived(spark, sf_dir).withColumn("referrer_platform", intent.referrer_platform(F.col("referrer")))
    return rows.groupBy("referrer", "referrer_platform").agg(F.count("*").alias("requests"))


def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return read_table(spark, sf_dir, "pages").select("page_id", urls.host(url).alias("host"), urls.path(url).alias("path"), urls.query_value(url, "page").alias("page"), urls.query_value(url, "ref").alias("ref"))


def sanitized_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "pages").select("page_id", urls.sanitized(F.col("url")).alias("clean"))


# Path segments that tell a page's kind, in order of precedence.
PATH_KINDS = [
    ("product", "products product p item items dp sku buy"),
    ("collection", "collections collection category categories catalog c shop"),
    ("article", "blog blogs news article articles post posts stories"),
    ("place", "locations location stores store-locator branches find-us visit"),
    ("service", "services service book booking appointments pricing plans"),
    ("faq", "faq faqs questions help"),
    ("document", "docs documentation reference guide guides manual api policies legal terms privacy"),
]


def path_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of pages by URL grammar; half of the paths get a known first segment."""
    named = F.element_at(F.array(*[F.lit(k.split(" ")[-1]) for _, k in PATH_KINDS]), (F.col("page_id") % len(PATH_KINDS) + 1).cast("int"))
    path = F.lower(urls.path(F.col("url")))
    path = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("/"), named, path)).otherwise(path)
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    kind = F.coalesce(*[F.when(F.arrays_overlap(segments, F.array(*map(F.lit, words.split(" ")))), F.lit(k)) for k, words in PATH_KINDS], F.lit("unknown"))
    return read_table(spark, sf_dir, "pages").groupBy(kind.alias("kind")).agg(F.count("*").alias("pages"))


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = detected(spark, sf_dir).select(F.col("ts").cast("timestamp").alias("ts"), "d.kind", "user_id")
    out = rows.groupBy(F.window("ts", "1 hour").alias("w"), "kind").agg(F.count("*").alias("requests"))
    return out.select(F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("hour"), "kind", "requests")


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived(spark, sf_dir).select(F.col("ts").cast("timestamp").alias("ts"), "user_id")
    out = rows.groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("requests"))
    return out.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("requests").alias("longest"))


def _sql(tail: str) -> str:
    return f"WITH {REQUESTS_SQL} {tail}"


_REF = f"coalesce({_HOST.format('referrer')}, CASE WHEN regexp_matches(lower(trim(referrer)), '^[a-z0-9.-]+$') THEN lower(trim(referrer)) END)"
_SEGMENTS = "list_filter(string_split(CASE WHEN page_id % 2 = 0 THEN '/' || [{0}][(page_id % {1} + 1)::INT] || lower({2}) ELSE lower({2}) END, '/'), lambda s: s <> '')".format(
    ", ".join(f"'{k.split(' ')[-1]}'" for _, k in PATH_KINDS), len(PATH_KINDS), _PATH.format("url")
)
_RAW = r"nullif(regexp_extract(regexp_extract(url, '\?([^#]*)', 1), '(?:^|&){0}=([^&]*)', 1), '')"
QUERIES = {
    "request_detection": (request_detection, _sql("SELECT event_id, kind, platform, confidence, false AS verified, md AS accepts_markdown, signals FROM detected")),
    "serving_paths": (
        serving_paths,
        _sql("""SELECT kind, CASE WHEN kind = 'protocol' THEN 'protocol' WHEN kind = 'agent' THEN CASE WHEN route IS NOT NULL AND NOT md THEN 'protocol' WHEN md OR coalesce(platform <> 'unknown', false) THEN 'markdown' ELSE 'html' END ELSE 'html' END AS path,
          count(*) AS requests, count(DISTINCT user_id) AS users FROM detected GROUP BY 1, 2"""),
    ),
    "kind_platform_cube": (kind_platform_cube, _sql("SELECT coalesce(kind, '*') AS kind, coalesce(platform, '*') AS platform, requests FROM (SELECT kind, platform, count(*) AS requests FROM (SELECT kind, coalesce(platform, 'none') AS platform FROM detected) GROUP BY CUBE (kind, platform))")),
    "referrer_platforms": (referrers, _sql(f"SELECT referrer, {case('h', intent.REFERRERS, chr(40) + '{v} = ' + chr(39) + '{k}' + chr(39) + ' OR ends_with({v}, ' + chr(39) + '.{k}' + chr(39) + '))')} AS referrer_platform, count(*) AS requests FROM (SELECT referrer, {_REF} AS h FROM requests) GROUP BY 1, 2")),
    "url_parts": (url_parts, f"SELECT page_id, {_HOST.format('url')} AS host, {_PATH.format('url')} AS path, {_RAW.format('page')} AS page, {_RAW.format('ref')} AS ref FROM pages"),
    "sanitized_urls": (sanitized_urls, f"SELECT page_id, CASE WHEN NOT regexp_matches(url, '[?#]') THEN url ELSE regexp_extract(url, '^([^?#]*)', 1) || coalesce('?page=' || {_RAW.format('page')}, '') END AS clean FROM pages"),
    "path_kinds": (
        path_kinds,
        "SELECT CASE " + " ".join(f"WHEN list_has_any(s, [{', '.join(chr(39) + w + chr(39) for w in ws.split(' '))}]) THEN '{k}'" for k, ws in PATH_KINDS) + f" ELSE 'unknown' END AS kind, count(*) AS pages FROM (SELECT {_SEGMENTS} AS s FROM pages) GROUP BY 1",
    ),
    "requests_hourly": (hourly, _sql("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS hour, kind, count(*) AS requests FROM detected GROUP BY 1, 2")),
    "request_sessions": (
        sessions,
        """WITH e AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        s AS (SELECT user_id, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM e)
        SELECT user_id, count(*) AS sessions, max(requests) AS longest FROM (SELECT user_id, session, count(*) AS requests FROM s GROUP BY 1, 2) GROUP BY 1""",
    ),
}
