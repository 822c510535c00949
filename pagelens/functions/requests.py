"""Who made a request: header evidence and classification as Column expressions.

headers is MAP<STRING, ARRAY<STRING>>. Every function is a pure expression, so
a classified scan stays one whole-stage-codegen pipeline without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelens.functions import urls

# User agents of crawlers, and of agents, first match wins.
CRAWLER_AGENTS = [
    ("googlebot", "googlebot"), ("bingbot", "bingbot"), ("adidxbot", "bingbot"), ("microsoftpreview", "microsoft-preview"), ("applebot", "applebot"),
]
AGENT_AGENTS = [
    ("claude-code", "claude-code"), ("opencode", "opencode"), ("chatgpt-user", "chatgpt"), ("oai-searchbot", "chatgpt"), ("gptbot", "chatgpt"),
    ("perplexitybot", "perplexity"), ("perplexity-user", "perplexity"), ("google-extended", "gemini"), ("gemini", "gemini"), ("claude-web", "claude"),
    ("claudebot", "claude"), ("claude-user", "claude"), ("anthropic-ai", "claude"), ("meta-externalagent", "meta"), ("meta-externalfetcher", "meta"),
    ("amazonbot", "amazon"), ("duckassistbot", "duckduckgo"), ("mistralai-user", "mistral"),
]
SIGNATURE_DOMAINS = [
    ("chatgpt.com", "chatgpt"), ("openai.com", "chatgpt"), ("claude.ai", "claude"), ("anthropic.com", "claude"), ("perplexity.ai", "perplexity"), ("gemini.google.com", "gemini"),
]
PROTOCOL_ROUTES = ["/.well-known/ucp", "/.well-known/acp", "/mcp", "/acp"]


def header(headers: Column, name: str) -> Column:
    """Value of a header by case-insensitive name, several joined by a comma; null if absent."""
    held = F.filter(F.map_entries(headers), lambda e: (F.lower(e["key"]) == name) & e["value"].isNotNull())
    return F.array_join(F.get(held, F.lit(0))["value"], ", ")


def media_ranges(accept: Column) -> Column:
    """ARRAY<STRUCT<type, q>> of an Accept header; q is 1 unless a finite one is given, and an empty one is 0."""

    def one(part: Column) -> Column:
        segments = F.split(part, ";")
        kind = F.lower(F.trim(F.get(segments, F.lit(0))))
        qs = F.filter(segments, lambda s: F.regexp_extract(F.lower(s), r"^\s*(q)\s*=", 1) == "q")
        texts = F.transform(qs, lambda s: F.trim(F.regexp_extract(s, r"=([\s\S]*)", 1)))
        numbers = F.transform(texts, lambda t: F.when(t == "", 0.0).when(t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), t.try_cast("double")))
        finite = F.filter(numbers, lambda v: v.isNotNull() & (F.abs(v) < float("inf")))
        return F.struct(kind.alias("type"), F.coalesce(F.try_element_at(finite, F.lit(-1)), F.lit(1.0)).alias("q"))

    return F.filter(F.transform(F.split(accept, ","), one), lambda r: r["type"] != "")


def accepts(accept: Column, media_type: str) -> Column:
    """Whether a type is named with q above 0; wildcards do not count, no header is no."""
    return F.coalesce(F.exists(media_ranges(accept), lambda r: (r["type"] == media_type) & (r["q"] > 0)), F.lit(False))


def signature_host(value: Column) -> Column:
    """Host named by a Signature-Agent header, or its text; null if empty."""
    first = F.trim(F.get(F.split(value, ","), F.lit(0)))
    bare = F.nullif(F.trim(F.regexp_replace(F.regexp_replace(first, '^"', ""), '"$', "")), F.lit(""))
    return F.coalesce(urls.host(bare), F.lower(bare))


def protocol_route(path: Column) -> Column:
    """The protocol route that a path is or lies below; null if none."""
    own = F.coalesce(F.nullif(F.regexp_replace(F.lower(path), "/+$", ""), F.lit("")), F.lit("/"))
    return F.coalesce(*[F.when((own == r) | own.startswith(f"{r}/"), F.lit(r)) for r in PROTOCOL_ROUTES])


def _first_entry(agent: Column, table: list[tuple[str, str]]) -> Column:
    return F.coalesce(*[F.when(agent.contains(p), F.struct(F.lit(p).alias("pattern"), F.lit(v).alias("platform"))) for p, v in table])


def detect(rows: DataFrame, headers: str = "headers", url: str = "url", out: str = "detection") -> DataFrame:
    """rows with STRUCT<kind, platform, verified, accepts_markdown, signals, confidence> added.

    Evidence is computed in steps of its own columns: as one expression it would
    repeat each parsed header at every use and outgrow generated code.
    """
    h = F.col(headers)
    accept, agent = F.col("__accept"), F.col("__agent")
    crawler, known, signer, signed, route = (F.col(f"__{x}") for x in ("crawler", "known", "signer", "signed", "route"))
    markdown, html, browser, signer_platform = (F.col(f"__{x}") for x in ("markdown", "html", "browser", "signer_platform"))
    steps = [
        {"accept": header(h, "accept"), "agent": F.lower(F.coalesce(header(h, "user-agent"), F.lit(""))), "signer_text": header(h, "signature-agent"),
         "signed": header(h, "signature").isNotNull() & header(h, "signature-input").isNotNull(), "path": urls.path(F.col(url))},
        {"markdown": accepts(accept, "text/markdown"), "html": accepts(accept, "text/html"), "crawler": _first_entry(agent, CRAWLER_AGENTS),
         "known_any": _first_entry(agent, AGENT_AGENTS), "browser": agent.contains("mozilla/"), "signer": signature_host(F.col("__signer_text")), "route": protocol_route(F.col("__path"))},
        {"known": F.when(crawler.isNull(), F.col("__known_any")), "signer_platform": F.when(signer.isNotNull(), F.coalesce(urls.by_domain(signer, SIGNATURE_DOMAINS), F.lit("unknown")))},
    ]
    named = rows
    for step in steps:
        named = named.withColumns({f"__{k}": v for k, v in step.items()})
    human = crawler.isNull() & ~markdown & signer.isNull() & ~signed & route.isNull() & known.isNull()
    kind = F.when(crawler.isNotNull(), "crawler").when(markdown | signer.isNotNull() | signed, "agent").when(route.isNotNull(), "protocol").when(known.isNotNull(), "agent").otherwise("human")
    platform = (
        F.when(crawler.isNotNull(), crawler["platform"])
        .when(markdown | signer.isNotNull() | signed, F.coalesce(signer_platform, known["platform"], F.lit("unknown")))
        .otherwise(known["platform"])
    )
    confidence = (
        F.when(crawler.isNotNull(), "medium").when(markdown | signer.isNotNull(), "high").when(signed, "medium").when(route.isNotNull(), "high")
        .when(known.isNotNull(), "medium").when(html | browser, "high").otherwise("low")
    )
    signals = F.array_compact(
        F.array(
            F.when(markdown, F.lit("accept:text/markdown")),
            F.when(signer.isNotNull(), F.concat(F.lit("signature-agent:"), signer)),
            F.when(signed, F.lit("web-bot-auth:signature")),
            F.when(route.isNotNull(), F.concat(F.lit("protocol:"), route)),
            F.when(crawler.isNotNull(), F.concat(F.lit("ua:"), crawler["pattern"])),
            F.when(known.isNotNull(), F.concat(F.lit("ua:"), known["pattern"])),
            F.when(human & html, F.lit("accept:text/html")).when(human & browser, F.lit("ua:browser")),
        )
    )
    done = F.struct(kind.alias("kind"), platform.alias("platform"), F.lit(False).alias("verified"), markdown.alias("accepts_markdown"), signals.alias("signals"), confidence.alias("confidence"))
    return named.withColumn(out, done).drop(*[f"__{k}" for step in steps for k in step])


def serving_path(detection: Column) -> Column:
    """markdown, protocol or html: what a classified request is served."""
    on_route = F.exists(detection["signals"], lambda s: s.startswith("protocol:"))
    named = F.coalesce(detection["platform"] != "unknown", F.lit(False))
    agent = F.when(on_route & ~detection["accepts_markdown"], "protocol").when(detection["accepts_markdown"] | named, "markdown").otherwise("html")
    return F.when(detection["kind"] == "protocol", "protocol").when(detection["kind"] == "agent", agent).otherwise("html")


def apply_verification(detection: Column, verified: Column, platform: Column) -> Column:
    """A detection with a verdict merged in; a verified platform fills only one that is null or unknown."""
    open_ = detection["platform"].isNull() | (detection["platform"] == "unknown")
    return detection.withField("verified", verified).withField("platform", F.when(verified & open_, F.coalesce(platform, detection["platform"])).otherwise(detection["platform"]))


def absolute_url(host: Column, proto: Column, path: Column) -> Column:
    """A request's URL from its Host and X-Forwarded-Proto headers and its path; https unless the first proto says http."""
    scheme = F.when(F.lower(F.trim(F.get(F.split(proto, ","), F.lit(0)))) == "http", "http").otherwise("https")
    return F.concat(scheme, F.lit("://"), F.coalesce(host, F.lit("localhost")), path)
