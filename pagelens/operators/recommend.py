"""Fixes for a page: templates joined to its checks, each lost point claimed once by the first template that closes or opens its check."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

EFFORTS = ["config", "template", "engineering"]
# Templates in order, with their effort and the checks they close.
TEMPLATES = [
    ("fix-robots-policy", "config", ["retrievability.robots-policy"]), ("render-without-javascript", "engineering", ["retrievability.render-independence"]),
    ("serve-machine-representation", "config", ["machine-representation.negotiated-response"]), ("declare-alternates", "config", ["machine-representation.declared-alternates"]),
    ("declare-vary-accept", "config", ["machine-representation.vary-accept"]), ("resolve-substance-divergence", "engineering", ["machine-representation.substance-parity"]),
    ("add-core-facts", "template", ["fact-coverage.core-facts"]), ("reduce-page-weight", "engineering", ["fact-coverage.context-cost"]),
    ("front-load-core-facts", "template", ["fact-position.first-core-fact-offset", "fact-position.front-window"]), ("add-structured-data", "template", ["structured-data.present"]),
    ("complete-required-properties", "template", ["structured-data.required-properties"]), ("align-structured-data-with-text", "template", ["structured-data.text-agreement"]),
    ("declare-canonical", "config", ["contract-discovery.canonical"]), ("add-cache-validators", "config", ["contract-discovery.cache-validators"]), ("publish-llms-txt", "config", ["contract-discovery.llms-txt"]),
    ("declare-sitemap", "config", ["contract-discovery.sitemap"]), ("declare-machine-endpoint", "engineering", ["contract-discovery.machine-endpoint"]), ("state-quantities", "template", ["evidence-density.quantities"]),
    ("label-facts", "template", ["evidence-density.definitions"]), ("add-comparison-rows", "template", ["evidence-density.comparisons"]),
]
# Checks that a template opens once its own is closed, and the checks that must have earned nothing for that.
UNLOCKS = [
    ("serve-machine-representation", "machine-representation.vary-accept", []),
    ("serve-machine-representation", "machine-representation.substance-parity", ["machine-representation.negotiated-response"]),
    ("add-core-facts", "fact-position.first-core-fact-offset", ["fact-position.first-core-fact-offset", "fact-position.front-window"]),
    ("add-core-facts", "fact-position.front-window", ["fact-position.first-core-fact-offset", "fact-position.front-window"]),
    ("add-structured-data", "structured-data.required-properties", ["structured-data.present"]),
    ("add-structured-data", "structured-data.text-agreement", ["structured-data.present"]),
]
#: template, its place and effort, check, whether the template closes it, and what must have earned nothing.
ROWS = [(i, t, EFFORTS.index(e), c, True, []) for i, (t, e, cs) in enumerate(TEMPLATES) for c in cs] + [
    (i, t, EFFORTS.index(e), c, False, zero) for i, (t, e, _) in enumerate(TEMPLATES) for u, c, zero in UNLOCKS if u == t
]


def recommend(checks: DataFrame, page: str = "page") -> DataFrame:
    """checks (page, check, weight, earned) as rows page, rank, fix, effort, points, closes, opens; pages without a lost point have none.

    Fixes are ranked by all points that they could bring, then by effort, then in
    order of the templates; a point counts for the first fix that brings it. A
    page has one row for each check, so its windows are small.
    """
    spark = checks.sparkSession
    rules = F.broadcast(spark.createDataFrame(ROWS, "place int, fix string, effort int, check string, closes boolean, zero array<string>"))  # a fixed number of rows
    gaps = checks.select(page, "check", F.greatest(F.col("weight") - F.col("earned"), F.lit(0)).alias("gap"), (F.col("earned") == 0).alias("nothing"))
    nothing = gaps.where("nothing").groupBy(page).agg(F.collect_list("check").alias("unearned"))
    rows = gaps.join(rules, "check").join(nothing, page, "left")
    able = rows.where(F.size(F.array_except("zero", F.coalesce("unearned", F.array().cast("array<string>")))) == 0)
    by_fix = Window.partitionBy(page, "place")
    valued = able.withColumn("own", F.sum(F.when(F.col("closes"), F.col("gap")).otherwise(0)).over(by_fix)).withColumn("raw", F.sum("gap").over(by_fix)).where("own > 0 and gap > 0")
    ranked = valued.withColumn("order", F.dense_rank().over(Window.partitionBy(page).orderBy(F.desc("raw"), "effort", "place")))
    first = ranked.withColumn("claim", F.row_number().over(Window.partitionBy(page, "check").orderBy("order"))).where("claim = 1")
    names = lambda test: F.array_join(F.array_sort(F.collect_list(F.when(test, F.col("check")))), ",")
    out = first.groupBy(page, "order", "fix", "effort").agg(F.sum("gap").cast("long").alias("points"), names(F.col("closes")).alias("closes"), names(~F.col("closes")).alias("opens"))
    effort = F.get(F.array(*map(F.lit, EFFORTS)), F.col("effort"))
    return out.select(page, F.row_number().over(Window.partitionBy(page).orderBy("order")).alias("rank"), "fix", effort.alias("effort"), "points", "closes", "opens")
