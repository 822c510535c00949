"""What a request wanted: scrubbed queries, referrers, capability signals, demand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelens.functions import urls

QUERY_MAX = 200
# Search parameters and referring platforms, in the order that decides.
SEARCH_PARAMS = ["q", "query", "search", "s", "keyword", "term"]
REFERRERS = [
    ("chatgpt.com", "chatgpt"), ("chat.openai.com", "chatgpt"), ("perplexity.ai", "perplexity"), ("claude.ai", "claude"), ("gemini.google.com", "gemini"), ("bard.google.com", "gemini"),
    ("copilot.microsoft.com", "copilot"), ("meta.ai", "meta"), ("grok.com", "grok"), ("x.ai", "grok"), ("chat.mistral.ai", "mistral"), ("you.com", "you"),
]
# Capabilities (id, kind, intent), action states, and what tools and words ask for.
CAPABILITIES = [
    ("catalog.search", "information", "product-information"), ("product.read", "information", "product-information"), ("availability.read", "information", "availability"),
    ("pricing.read", "information", "price"), ("policy.read", "information", "discovery"), ("quote.request", "action", "price"), ("booking.create", "action", "booking"),
    ("checkout.create", "action", "checkout"), ("terms.negotiate", "action", "custom-terms"), ("support.request", "action", "support"),
]
ACTION_STATES = ["requested", "offered", "succeeded", "failed", "unsupported"]
TOOL_CATEGORIES = [
    ("ucp.discovery", "discovery"), ("ucp.catalog", "product-information"), ("ucp.checkout", "checkout"), ("acp.feed", "product-information"),
    ("mcp.search_catalog", "product-information"), ("mcp.get_product", "product-information"), ("mcp.get_policies", "discovery"),
]
QUERY_CATEGORIES = [
    (r"\b(checkout|check out|payment link|buy now)\b", "checkout"),
    (r"\b(bundle|discount|negotiate|negotiation|custom terms|payment terms|bulk pric\w*)\b", "custom-terms"),
    (r"\b(book|booking|reserve|reservation|schedule|appointment)\b", "booking"),
    (r"\b(available|availability|in stock|inventory|stock level)\b", "availability"),
    (r"\b(price|pricing|cost|quote|how much)\b", "price"),
    (r"\b(ship|shipping|delivery|deliver)\b", "delivery"),
    (r"\b(cancel|cancellation|refund|returns?)\b", "cancellation"),
    (r"\b(compare|comparison|versus|alternatives?)\b", "comparison"),
    (r"\b(support|troubleshoot|broken|help desk)\b", "support"),
]
COMMERCIAL = ["product-information", "availability", "price", "delivery", "booking", "comparison", "custom-terms", "checkout"]
PATH_CATEGORIES = [
    (r"^/(products?|catalog|collections?)(/|$)", "product-information"), (r"^/(pricing|prices)(/|$)", "price"), (r"^/(checkout|cart)(/|$)", "checkout"),
]


def scrub_query(raw: Column) -> Column:
    """A search text with white space collapsed; null if it is empty, long, or may hold personal data."""
    text = F.trim(F.regexp_replace(raw, r"[\s\x{a0}\x{feff}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{1680}]+", " "))
    joined = F.regexp_replace(text, r"[ ().+-]", "")
    bad = (text == "") | (F.length(text) > QUERY_MAX) | text.contains("@") | text.contains("://") | joined.rlike(r"[0-9]{7,}") | text.rlike(r"[A-Za-z0-9_-]{24,}")
    return F.when(~bad, text)


def referrer_platform(referrer: Column) -> Column:
    """Platform of a referring URL or bare host; null if unknown."""
    bare = F.lower(F.trim(referrer))
    name = F.coalesce(urls.host(referrer), F.when(bare.rlike(r"^[a-z0-9.-]+$"), bare))
    return urls.by_domain(name, REFERRERS)


def url_intent(rows: DataFrame, url: Column, out: str = "intent") -> DataFrame:
    """rows with STRUCT<query, query_param, utm_source, utm_medium> added: the first search parameter that has a value decides, scrubbed or not.

    The query string is read once into a map, and each step has columns of its own, so no expression repeats another.
    """
    pairs = F.filter(F.split(F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1), "&"), lambda p: F.contains(p, F.lit("=")))
    held = F.aggregate(
        F.transform(pairs, lambda p: F.struct(F.regexp_extract(p, "^([^=]*)=", 1).alias("key"), F.try_url_decode(F.regexp_extract(p, "=(.*)$", 1)).alias("value"))),
        F.create_map().cast("map<string,string>"),
        lambda m, p: F.when(F.map_contains_key(m, p["key"]), m).otherwise(F.map_concat(m, F.map_from_arrays(F.array(p["key"]), F.array(p["value"])))),
    )
    value = lambda name: F.try_element_at("__params", F.lit(name))
    first = F.coalesce(*[F.when(F.nullif(value(p), F.lit("")).isNotNull(), F.lit(p)) for p in SEARCH_PARAMS])
    steps = [
        {"__params": held},
        {"__param": first, "__source": F.lower(F.trim(value("utm_source"))), "__medium": F.lower(F.trim(value("utm_medium")))},
        {"__query": scrub_query(F.try_element_at("__params", F.col("__param")))},
    ]
    named = rows
    for step in steps:
        named = named.withColumns(step)
    utm = lambda c: F.when(F.col(c).rlike(r"^[a-z0-9][a-z0-9._-]{0,63}$"), F.col(c))
    done = F.struct(F.col("__query").alias("query"), F.when(F.col("__query").isNotNull(), F.col("__param")).alias("query_param"), utm("__source").alias("utm_source"), utm("__medium").alias("utm_medium"))
    return named.withColumn(out, done).drop(*[k for step in steps for k in step])


def _lookup(key: Column, table: list[tuple[str, str]]) -> Column:
    return F.coalesce(*[F.when(key == k, F.lit(v)) for k, v in table])


def capability_signals(version: Column, requested: Column, missing: Column, status: Column) -> Column:
    """STRUCT<requested, missing, status> that a known vocabulary lets through; all null if the request names none, or contradicts itself."""
    known = (version == 1) & requested.isin([c[0] for c in CAPABILITIES])
    clash = F.coalesce((missing == requested) & (status == "succeeded"), F.lit(False))
    ok = F.coalesce(known, F.lit(False)) & ~clash
    action = requested.isin([c[0] for c in CAPABILITIES if c[1] == "action"])
    return F.struct(
        F.when(ok, requested).alias("requested"),
        F.when(ok & (missing == requested), missing).alias("missing"),
        F.when(ok & action & status.isin(ACTION_STATES), status).alias("status"),
    )


def classify_demand(rows: DataFrame, kind: Column, url: Column, tool: Column, query: Column, capability: Column, result_count: Column, path: Column, source: Column, coverage: Column, out: str = "demand") -> DataFrame:
    """rows with STRUCT<category, basis, commercial, gap, unfulfilled, denied> added; capability is from capability_signals.

    Computed in steps of its own columns, like the detection of requests.
    """
    agent, requested, missing, status = (F.col(f"__{x}") for x in ("agent", "requested", "missing", "status"))
    by_query, by_tool, by_capability, by_path, basis, category = (F.col(f"__by_{x}") for x in ("query", "tool", "capability", "path", "basis", "category"))
    basis_of = (
        F.when(~agent, "none").when((requested == "catalog.search") & by_query.isNotNull(), "query").when(requested.isNotNull(), "capability").when(by_tool == "checkout", "tool")
        .when(by_query.isNotNull(), "query").when(by_tool.isNotNull(), "tool").when(source.isin("product", "catalog"), "source").when(by_path.isNotNull(), "path").otherwise("none")
    )
    category_of = (
        F.when(basis == "query", by_query).when(basis == "capability", by_capability).when(basis == "tool", by_tool)
        .when(basis == "source", "product-information").when(basis == "path", by_path).otherwise("unknown")
    )
    steps = [
        {"agent": F.coalesce(kind.isin("agent", "protocol"), F.lit(False)), "requested": capability["requested"], "missing": capability["missing"], "status": capability["status"],
         "text": F.lower(scrub_query(query)), "own_path": F.when(urls.is_absolute(url), F.lower(urls.path(url)))},
        {"by_query": F.coalesce(*[F.when(F.col("__text").rlike(p), F.lit(c)) for p, c in QUERY_CATEGORIES]), "by_tool": _lookup(tool, TOOL_CATEGORIES),
         "by_capability": _lookup(requested, [(c[0], c[2]) for c in CAPABILITIES]), "by_path": F.coalesce(*[F.when(F.col("__own_path").rlike(p), F.lit(c)) for p, c in PATH_CATEGORIES])},
        {"by_basis": basis_of},
        {"by_category": category_of},
        {"commercial": agent & category.isin(COMMERCIAL), "denied": agent & F.coalesce(path == "denied", F.lit(False))},
    ]
    named = rows
    for step in steps:
        named = named.withColumns({f"__{k}": v for k, v in step.items()})
    commercial, denied = F.col("__commercial"), F.col("__denied")
    gap = F.when(
        commercial & ~denied,
        F.when(missing.isNotNull() | (status == "unsupported"), "missing-capability")
        .when(status == "failed", "action-failed")
        .when((path == "protocol") & (result_count == 0), "no-results")
        .when(coverage == "unsourced", "no-source"),
    )
    done = F.struct(category.alias("category"), basis.alias("basis"), commercial.alias("commercial"), gap.alias("gap"), gap.isNotNull().alias("unfulfilled"), denied.alias("denied"))
    return named.withColumn(out, done).drop(*[f"__{k}" for step in steps for k in step])
