"""Evaluations of renderings: summaries, and the gate that promotes a profile over the baseline."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def summarize(results: DataFrame) -> DataFrame:
    """Sums and counts of results for each profile and split."""
    sums = [F.sum(c).cast("long").alias(c) for c in ("correct", "total", "qualified", "qualifications")]
    return results.groupBy("profile", "split").agg(F.count("*").alias("runs"), *sums, F.count_if("fidelity").alias("fidelity_passed"), F.count_if(F.col("error").isNotNull()).alias("errors"))


def promotable(results: DataFrame, baseline: str = "baseline") -> DataFrame:
    """Profiles that never fall behind the baseline on the same case, model and repetition, never fail, and gain on a holdout case in every model and repetition."""
    key = ["case", "model", "repetition"]
    sound = F.col("error").isNull() & F.col("fidelity") & (F.col("actual") == F.col("profile"))
    rows = results.withColumn("sound", F.coalesce(sound, F.lit(False)))
    base = rows.where(F.col("profile") == baseline).select(*key, F.col("sound").alias("base_sound"), F.col("correct").alias("base_correct"), F.col("qualified").alias("base_qualified"))
    joined = rows.where(F.col("profile") != baseline).join(base, key, "left")
    good = F.col("sound") & F.coalesce("base_sound", F.lit(False)) & F.coalesce((F.col("correct") >= F.col("base_correct")) & (F.col("qualified") >= F.col("base_qualified")), F.lit(False))
    lift = (F.col("split") == "holdout") & F.coalesce(F.col("correct") > F.col("base_correct"), F.lit(False))
    runs = joined.groupBy("profile", "model", "repetition").agg(F.bool_and(good).alias("good"), F.bool_or(lift).alias("lift"))
    return runs.groupBy("profile").agg(F.bool_and(F.col("good") & F.col("lift")).alias("promotable"), F.count("*").alias("model_runs"))
