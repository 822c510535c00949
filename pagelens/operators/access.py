"""Access policies: rules compiled as rows, and the decision about each request as a join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_RULES = 100  # rules of a policy that count, from the first


def compile_rules(rules: DataFrame, verification: bool) -> DataFrame:
    """rules (ordinal, subject, action, requests, window_seconds) with `name` (the subject trimmed, in lower case) and `rejected` (why a rule does not count, or null).

    Of several usable rules for a subject the first counts. A policy is a small
    table: one window over its rules.
    """
    named = rules.withColumn("name", F.lower(F.trim(F.coalesce("subject", F.lit(""))))).withColumn("place", F.row_number().over(Window.orderBy("ordinal"))).where(F.col("place") <= MAX_RULES)
    unusable = ~F.coalesce((F.col("requests") > 0) & (F.col("window_seconds") > 0), F.lit(False))
    own = (
        F.when(F.col("name") == "", "rule has no subject").when(~F.coalesce(F.col("action").isin("allow", "deny", "limit"), F.lit(False)), "unknown action")
        .when((F.col("action") == "limit") & unusable, "limit rule needs positive requests and windowSeconds")
        .when(~F.col("name").isin("*", "unverified") & F.lit(not verification), "a rule naming a platform requires verification; without it the subject is a self-asserted header")
    )
    checked = named.withColumn("rejected", own)
    earlier = F.count_if(F.col("rejected").isNull()).over(Window.partitionBy("name").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1))
    return checked.withColumn("rejected", F.coalesce("rejected", F.when(earlier > 0, "duplicate subject; the first rule wins"))).drop("place")


def subject_of(requests: DataFrame, compiled: DataFrame, kind: Column, platform: Column, verified: Column, protocol_route: Column) -> DataFrame:
    """requests with matched (the subject that decides, or null) and that rule's action, requests and window_seconds.

    Only agents and protocol routes are under the policy; a verified platform's own
    rule comes first, then that for the unverified, then that for all.
    """
    usable = compiled.where("rejected is null").select("name", "action", F.col("requests").alias("limit_requests"), F.col("window_seconds").alias("limit_seconds"))
    table = F.broadcast(usable.agg(F.map_from_entries(F.collect_list(F.struct("name", F.struct("action", "limit_requests", "limit_seconds")))).alias("__rules")))  # one row, of MAX_RULES entries at most
    joined = requests.crossJoin(table)
    has = lambda name: F.coalesce(F.map_contains_key("__rules", name), F.lit(False))
    own = F.lower(F.coalesce(platform, F.lit("")))
    under = F.coalesce((kind == "agent") | ((kind != "crawler") & protocol_route), F.lit(False))
    name = F.when(under, F.when(verified & has(own), own).when(~verified & has(F.lit("unverified")), "unverified").when(has(F.lit("*")), "*"))
    out = joined.withColumn("under_policy", under).withColumn("matched", name)
    rule = F.try_element_at("__rules", F.col("matched"))
    return out.withColumn("action", rule["action"]).withColumn("limit_requests", rule["limit_requests"]).withColumn("limit_seconds", rule["limit_seconds"]).drop("__rules")


def decide(matched: DataFrame, default: str, within_limit: Column) -> DataFrame:
    """matched (from subject_of) with allowed and reason (denied, rate-limited or null). within_limit says whether a limited subject still has room."""
    denied = F.col("under_policy") & F.coalesce(F.col("action") == "deny", F.lit(default == "deny") & F.col("matched").isNull())
    limited = F.coalesce(F.col("action") == "limit", F.lit(False)) & ~within_limit
    reason = F.when(denied, "denied").when(limited, "rate-limited")
    return matched.withColumn("allowed", reason.isNull()).withColumn("reason", reason)


def denied_headers(reason: Column, retry_after: Column) -> Column:
    """Headers of the answer to a denied request."""
    plain = F.create_map(*map(F.lit, ("content-type", "application/json; charset=utf-8", "cache-control", "no-store")))
    return F.when((reason == "rate-limited") & retry_after.isNotNull(), F.map_concat(plain, F.create_map(F.lit("retry-after"), retry_after.cast("string")))).otherwise(plain)
