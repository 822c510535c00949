"""Queries about demand: scrubbed queries, intent of URLs, classified demand and its roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.functions import intent
from pagelens.plans.literal import case, table, values
from pagelens.plans.requests import REQUESTS_SQL, detected
from pagelens.sources.shared import read_table

# What the requests of a client say: tool, query, capability, missing, status, result count, response path, source, coverage.
SIGNALS = [
    ("mcp.search_catalog", "how much is a blue lamp", "catalog.search", None, None, 3, "protocol", None, "sourced"),
    ("mcp.search_catalog", None, None, None, None, 0, "protocol", None, "sourced"),
    (None, "compare both lamps", None, None, None, None, "markdown", "product", "sourced"),
    ("ucp.checkout", "price please", None, None, None, None, "protocol", None, "sourced"),
    (None, None, "checkout.create", "checkout.create", "unsupported", None, "protocol", None, "sourced"),
    (None, None, "booking.create", None, "failed", None, "protocol", None, "sourced"),
    (None, "my mail is a@b.example", None, None, None, None, "markdown", "catalog", "unsourced"),
    (None, None, None, None, None, None, "markdown", None, "unsourced"),
    (None, "call 07 700 900 123", None, None, None, None, "denied", "product", None),
    ("ucp.discovery", None, None, None, None, None, "protocol", None, None),
    (None, "is it in stock", "policy.read", None, None, None, "markdown", "policies", "not-applicable"),
    (None, "custom terms for a bundle", None, None, None, None, "denied", None, "unsourced"),
    ("tool.unknown", "refund for a broken lamp", "no.such", None, "failed", None, "markdown", None, None),
]
_ROWS = [(i, *s) for i, s in enumerate(SIGNALS)]
_SCHEMA = "say int, tool string, query string, requested string, missing string, status string, result_count int, response string, source string, coverage string"


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.broadcast(table(spark, _SCHEMA, _ROWS))  # a fixed number of rows
    rows = detected(spark, sf_dir).withColumn("say", (F.col("event_id") % len(_ROWS)).cast("int")).join(said, "say")
    signals = intent.capability_signals(F.lit(1), F.col("requested"), F.col("missing"), F.col("status"))
    return intent.classify_demand(rows, F.col("d.kind"), F.col("url"), F.col("tool"), F.col("query"), signals, F.col("result_count"), F.col("response"), F.col("source"), F.col("coverage"))


def demand_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = "demand"
    return _classified(spark, sf_dir).select("event_id", f"{d}.category", f"{d}.basis", f"{d}.commercial", f"{d}.gap", f"{d}.unfulfilled", f"{d}.denied")


def demand_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _classified(spark, sf_dir).select("d.kind", "demand.category", "demand.unfulfilled")
    out = rows.rollup("kind", "category").agg(F.count("*").alias("requests"), F.count_if("unfulfilled").alias("unfulfilled"))
    return out.select(F.coalesce("kind", F.lit("*")).alias("kind"), F.coalesce("category", F.lit("*")).alias("category"), "requests", "unfulfilled")


# Fixed texts for scrubbing, beside the conversations.
RAW = ["blue  lamp", " a@b.example ", "see https://x.example", "call (770) 090-0123", "x" * 201, "abcdefghijklmnopqrstuvwxyz", "", "   ", "size 42-44", "lamp\tred\n2 m", "123 456", "token_ABCDEFGHIJKLMNOPQRSTUVW1"]


def scrubbed_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = read_table(spark, sf_dir, "conversations").where("role = 'user'").select("text")
    both = texts.unionByName(table(spark, "text string", [(x,) for x in RAW]))
    return both.select(intent.scrub_query(F.col("text")).alias("query")).groupBy("query").agg(F.count("*").alias("n"))


# Query strings that follow a page's path.
SUFFIXES = ["?q=blue+lamp", "?s=&query=red%20lamp&utm_source=News", "?utm_medium=e-mail&term=x", "?search=a%40b.example&keyword=lamp", "", "?utm_source=-bad&q=", "?q=%zz", "#q=lamp", "?page=2&utm_source=ads_1"]


def url_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    suffix = F.element_at(F.array(*map(F.lit, SUFFIXES)), (F.col("page_id") % len(SUFFIXES) + 1).cast("int"))
    url = F.concat(F.regexp_extract("url", r"^([^?#]*)", 1), suffix)
    return intent.url_intent(read_table(spark, sf_dir, "pages").select("page_id", url.alias("url")), F.col("url")).select("page_id", "intent.*")


def _scrub(x: str) -> str:
    t = rf"trim(regexp_replace({x}, '[\s\x{{a0}}\x{{feff}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}\x{{1680}}]+', ' ', 'g'))"
    bad = rf"{t} = '' OR length({t}) > {intent.QUERY_MAX} OR contains({t}, '@') OR contains({t}, '://') OR regexp_matches(regexp_replace({t}, '[ ().+-]', '', 'g'), '[0-9]{{7,}}') OR regexp_matches({t}, '[A-Za-z0-9_-]{{24,}}')"
    return f"CASE WHEN NOT ({bad}) THEN {t} END"


_CAPABLE = f"""{values("said", "say, tool, query, requested, missing, status, result_count, response, source, coverage", _ROWS)},
{REQUESTS_SQL}, spoken AS (
  SELECT d.*, s.*, kind IN ('agent', 'protocol') AS agent, {_scrub("query")} AS clean,
    requested IN ({", ".join(f"'{c[0]}'" for c in intent.CAPABILITIES)}) AND NOT coalesce(missing = requested AND status = 'succeeded', false) AS ok
  FROM detected d JOIN said s ON s.say = d.event_id % {len(_ROWS)}
), capable AS (
  SELECT *, CASE WHEN ok THEN requested END AS req, CASE WHEN ok AND missing = requested THEN missing END AS mis,
    CASE WHEN ok AND requested IN ({", ".join(f"'{c[0]}'" for c in intent.CAPABILITIES if c[1] == "action")}) AND status IN ({", ".join(f"'{s}'" for s in intent.ACTION_STATES)}) THEN status END AS st,
    {case("lower(clean)", intent.QUERY_CATEGORIES, "regexp_matches({v}, '{k}')")} AS by_query, {case("tool", intent.TOOL_CATEGORIES, "{v} = '{k}'")} AS by_tool,
    {case("lower(" + "coalesce(nullif(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1), ''), '/')" + ")", intent.PATH_CATEGORIES, "regexp_matches({v}, '{k}')")} AS by_path
  FROM spoken
), chosen AS (
  SELECT *, CASE WHEN NOT agent THEN 'none' WHEN req = 'catalog.search' AND by_query IS NOT NULL THEN 'query' WHEN req IS NOT NULL THEN 'capability' WHEN by_tool = 'checkout' THEN 'tool'
    WHEN by_query IS NOT NULL THEN 'query' WHEN by_tool IS NOT NULL THEN 'tool' WHEN source IN ('product', 'catalog') THEN 'source' WHEN by_path IS NOT NULL THEN 'path' ELSE 'none' END AS basis
  FROM capable
), categorised AS (
  SELECT *, CASE basis WHEN 'query' THEN by_query WHEN 'tool' THEN by_tool WHEN 'source' THEN 'product-information' WHEN 'path' THEN by_path
    WHEN 'capability' THEN {case("req", [(c[0], c[2]) for c in intent.CAPABILITIES], "{v} = '{k}'")} ELSE 'unknown' END AS category
  FROM chosen
), demanded AS (
  SELECT *, agent AND category IN ({", ".join(f"'{c}'" for c in intent.COMMERCIAL)}) AS commercial, agent AND coalesce(response = 'denied', false) AS denied FROM categorised
), gaps AS (
  SELECT *, CASE WHEN commercial AND NOT denied THEN CASE WHEN mis IS NOT NULL OR st = 'unsupported' THEN 'missing-capability' WHEN st = 'failed' THEN 'action-failed'
    WHEN response = 'protocol' AND result_count = 0 THEN 'no-results' WHEN coverage = 'unsourced' THEN 'no-source' END END AS gap
  FROM demanded
)"""
_URL = f"(regexp_extract(url, '^([^?#]*)', 1) || [{', '.join(chr(39) + s + chr(39) for s in SUFFIXES)}][(page_id % {len(SUFFIXES)} + 1)::INT])"
_PARAM = r"regexp_extract(regexp_extract(u, '\?([^#]*)', 1), '(?:^|&){0}=([^&]*)', 1)"
_DECODED = r"CASE WHEN NOT regexp_matches({0}, '%([^0-9a-fA-F]|.[^0-9a-fA-F]|.?$)') THEN nullif(url_decode(replace({0}, '+', ' ')), '') END"
QUERIES = {
    "demand_classification": (demand_classification, f"WITH {_CAPABLE} SELECT event_id, category, basis, commercial, gap, gap IS NOT NULL AS unfulfilled, denied FROM gaps"),
    "demand_rollup": (
        demand_rollup,
        f"WITH {_CAPABLE} SELECT coalesce(kind, '*') AS kind, coalesce(category, '*') AS category, requests, unfulfilled FROM (SELECT kind, category, count(*) AS requests, count(*) FILTER (gap IS NOT NULL) AS unfulfilled FROM gaps GROUP BY ROLLUP (kind, category))",
    ),
    "scrubbed_queries": (
        scrubbed_queries,
        f"WITH {values('raw', 'text', [(x,) for x in RAW])} SELECT query, count(*) AS n FROM (SELECT {_scrub('text')} AS query FROM (SELECT text FROM conversations WHERE role = 'user' UNION ALL SELECT text FROM raw)) GROUP BY 1",
    ),
    "url_intent": (
        url_intent,
        "WITH u AS (SELECT page_id, " + _URL + " AS u FROM pages), v AS (SELECT page_id, " + ", ".join(f"{_DECODED.format(_PARAM.format(p))} AS {p}_" for p in [*intent.SEARCH_PARAMS, "utm_source", "utm_medium"]) + " FROM u), f AS (SELECT *, "
        + f"coalesce({', '.join(p + '_' for p in intent.SEARCH_PARAMS)}) AS raw, CASE {' '.join(f'WHEN {p}_ IS NOT NULL THEN ' + chr(39) + p + chr(39) for p in intent.SEARCH_PARAMS)} END AS param FROM v), s AS (SELECT *, {_scrub('raw')} AS query FROM f) "
        + "SELECT page_id, query, CASE WHEN query IS NOT NULL THEN param END AS query_param, " + ", ".join(f"CASE WHEN regexp_matches(lower(trim({p}_)), '^[a-z0-9][a-z0-9._-]{{0,63}}$') THEN lower(trim({p}_)) END AS {p}" for p in ("utm_source", "utm_medium")) + " FROM s",
    ),
}
