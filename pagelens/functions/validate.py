"""The first problem of an event, in a fixed order of checks; null if it is valid."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KINDS = ["agent", "human", "protocol", "crawler"]
PATHS = ["markdown", "html-variant", "protocol", "denied"]
COVERAGES = ["sourced", "unsourced", "not-applicable"]

#: The columns of a typed event; a null is a missing field.
SCHEMA = (
    "event_id string, ts string, store_id string, requester struct<kind: string, platform: string, verified: boolean>, "
    "request struct<url: string, intent_signals: map<string,string>, accept: string, referrer: string>, "
    "response struct<path: string, variant_id: string, render_ms: double, source: string, coverage: string, profile_id: string, profile_version: long, compatibility_runtime: long>, "
    "outcome struct<purchase: boolean, order_value_minor: bigint, currency: string, order_value: double>"
)


def first_problem() -> Column:
    """Over the columns of SCHEMA."""
    c = F.col
    missing = lambda field: (c(field).isNull(), f"missing required field '{field}'")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    checks = [
        missing("event_id"), missing("ts"), missing("store_id"),
        missing("requester"), missing("requester.kind"), (~c("requester.kind").isin(KINDS), "'requester.kind' is not a known kind"), missing("requester.verified"),
        missing("request"), missing("request.url"), missing("request.intent_signals"),
        missing("response"), missing("response.path"), (~c("response.path").isin(PATHS), "'response.path' is not a known path"),
        missing("response.render_ms"), (~finite(c("response.render_ms")), "'response.render_ms' must be a finite number"),
        (~c("response.profile_id").rlike("^[a-z0-9-]{1,64}$"), "'response.profile_id' must be a bounded profile identifier"),
        (c("response.profile_version") < 1, "'response.profile_version' must be a positive integer"),
        (c("response.compatibility_runtime") < 1, "'response.compatibility_runtime' must be a positive integer"),
        (~c("response.coverage").isin(COVERAGES), "'response.coverage' is not a known coverage"),
        (c("outcome.order_value_minor").isNotNull() & ((c("outcome.order_value_minor") < 0) | c("outcome.currency").isNull()), "'outcome.order_value_minor' requires nonnegative integer minor units and currency"),
        (~c("outcome.currency").rlike("^[A-Z]{3}$"), "'outcome.currency' must be a three-letter uppercase currency code"),
        (c("outcome.order_value").isNotNull() & ~finite(c("outcome.order_value")), "'outcome.order_value' must be a finite number"),
    ]
    return F.coalesce(*[F.when(test, F.lit(message)) for test, message in checks])
