"""Assembling events and their intent signals, and validating capability snapshots, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagelens.functions import intent, urls

# Capabilities that known tools ask for, and the states and sources of a declared capability.
TOOL_CAPABILITIES = {
    "mcp.search_catalog": "catalog.search", "mcp.get_product": "product.read", "mcp.get_policies": "policy.read", "ucp.catalog": "catalog.search", "acp.feed": "catalog.search", "ucp.checkout": "checkout.create",
}
STATES, EVIDENCE = ["declared", "verified", "unavailable", "unknown"], ["merchant", "probe", "event"]
SIGNAL_HEADERS = {"tool": "x-intent-tool", "query": "x-intent-query", "results": "x-intent-results", "requested": "x-intent-capability", "missing": "x-intent-missing-capability", "status": "x-intent-action-status"}
_TOOL = "^(?i)[a-z0-9._-]{1,64}$"
_STAMP = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}\.[0-9]{3}Z$"


def protocol_signals(tool: Column, query: Column, result_count: Column, requested: Column, missing: Column, status: Column) -> Column:
    """STRUCT of what a protocol call says: tool, query (scrubbed), query_param, result_count, requested, missing, status."""
    known = F.coalesce(*[F.when(tool == t, F.lit(c)) for t, c in TOOL_CAPABILITIES.items()])
    own = intent.capability_signals(F.lit(1), F.coalesce(requested, known), missing, status)
    text = intent.scrub_query(query)
    return F.struct(
        tool.alias("tool"), text.alias("query"), F.when(text.isNotNull(), tool).alias("query_param"), F.when(result_count >= 0, result_count.cast("long")).alias("result_count"),
        own["requested"].alias("requested"), own["missing"].alias("missing"), own["status"].alias("status"),
    )


def stamp_headers(headers: Column, s: Column) -> Column:
    """headers (MAP<STRING, STRING>, lower-case names) with the signals of protocol_signals in headers of their own."""
    said = {"tool": F.when(s["tool"].rlike(_TOOL), s["tool"]), "query": F.replace(F.url_encode(s["query"]), F.lit("+"), F.lit("%20")), "results": s["result_count"].cast("string"), **{k: s[k] for k in ("requested", "missing", "status")}}
    entries = F.filter(F.array(*[F.struct(F.lit(SIGNAL_HEADERS[k]).alias("key"), v.alias("value")) for k, v in said.items()]), lambda e: e["value"].isNotNull())
    return F.map_concat(strip_headers(headers), F.map_from_entries(entries))


def strip_headers(headers: Column) -> Column:
    return F.map_filter(headers, lambda k, _: ~k.isin(list(SIGNAL_HEADERS.values())))


def read_headers(headers: Column) -> Column:
    """The signals that stamp_headers wrote; what does not hold is null, and a query counts only with its tool."""
    get = lambda k: F.try_element_at(headers, F.lit(SIGNAL_HEADERS[k]))
    tool = F.when(get("tool").rlike(_TOOL), get("tool"))
    query = F.when(tool.isNotNull(), intent.scrub_query(F.try_url_decode(F.replace(get("query"), F.lit("+"), F.lit("%2B")))))
    own = intent.capability_signals(F.lit(1), get("requested"), get("missing"), get("status"))
    count = F.when(get("results").rlike("^[0-9]{1,9}$"), get("results").try_cast("long"))
    return F.struct(tool.alias("tool"), query.alias("query"), F.when(query.isNotNull(), tool).alias("query_param"), count.alias("result_count"), own["requested"].alias("requested"), own["missing"].alias("missing"), own["status"].alias("status"))


def build_event(event_id: Column, ts: Column, store: Column, detection: Column, url: Column, signals: Column, accept: Column, referrer: Column, path: Column, render_ms: Column, source: Column, coverage: Column) -> Column:
    """An event as a struct; event_id and ts come from the caller, so that a task that runs again makes the same event. Unknown platforms are left out."""
    platform = F.when(detection["platform"] != "unknown", detection["platform"])
    return F.struct(
        event_id.alias("event_id"), ts.alias("ts"), store.alias("store_id"),
        F.struct(detection["kind"].alias("kind"), platform.alias("platform"), detection["verified"].alias("verified")).alias("requester"),
        F.struct(urls.sanitized(url).alias("url"), signals.alias("intent_signals"), accept.alias("accept"), referrer.alias("referrer")).alias("request"),
        F.struct(path.alias("path"), render_ms.alias("render_ms"), source.alias("source"), coverage.alias("coverage")).alias("response"),
    )


def is_public_domain(name: Column) -> Column:
    labels = F.split(name, r"\.", -1)
    fine = F.forall(labels, lambda x: x.rlike("^[a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?$"))
    return F.coalesce((F.length(name) <= 253) & ~name.rlike("^[0-9.]+$") & ~name.rlike(r"(?:^|\.)(?:localhost|local|internal|test|invalid|example)$") & (F.size(labels) >= 2) & fine, F.lit(False))


def endpoint(url: Column) -> Column:
    """The normal form of a public https URL without port, user, query or fragment; null for others."""
    shape = r"^(?i:https)://([^/?#@:]+)(?::443)?(/[^?#]*)?$"
    host = F.lower(F.regexp_extract(url, shape, 1))
    path = F.coalesce(F.nullif(F.regexp_extract(url, shape, 2), F.lit("")), F.lit("/"))
    return F.when((F.length(url) <= 2048) & url.rlike(shape) & is_public_domain(host), F.concat(F.lit("https://"), host, path))


def _stamp(value: Column) -> Column:
    return F.coalesce(value.rlike(_STAMP) & F.substring(value, 1, 23).try_cast("timestamp_ntz").isNotNull(), F.lit(False))


def is_snapshot(version: Column, domain: Column, generated_at: Column, capabilities: Column) -> Column:
    """Whether a capability snapshot holds as a whole; capabilities is ARRAY<STRUCT<id, status, endpoint, checked_at, evidence_source>>."""
    ids, actions = [c[0] for c in intent.CAPABILITIES], [c[0] for c in intent.CAPABILITIES if c[1] == "action"]

    def fine(x: Column) -> Column:
        verified = F.coalesce(x["status"] == "verified", F.lit(False))
        return (
            F.coalesce(x["id"].isin(ids) & x["status"].isin(STATES) & x["evidence_source"].isin(EVIDENCE), F.lit(False))
            & (x["endpoint"].isNull() | F.coalesce(endpoint(x["endpoint"]) == x["endpoint"], F.lit(False)))
            & (x["checked_at"].isNull() | (_stamp(x["checked_at"]) & (x["checked_at"] <= generated_at)))
            & ~(verified & (x["endpoint"].isNull() | x["checked_at"].isNull() | (x["evidence_source"] == "merchant")))
            & ~(verified & (x["evidence_source"] == "probe") & x["id"].isin(actions))
        )

    once = F.size(F.array_distinct(F.transform(capabilities, lambda x: x["id"]))) == F.size(capabilities)
    return F.coalesce((version == 1) & is_public_domain(domain) & _stamp(generated_at) & (F.size(capabilities) <= len(ids)) & once & F.forall(capabilities, fine), F.lit(False))
