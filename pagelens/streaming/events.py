"""Streams of events: a sink with quarantine, roll-ups by event time, limits with state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pagelens.functions import validate


def write_events(events: DataFrame, path: str, quarantine: str, checkpoint: str, late: str = "1 hour", **trigger) -> StreamingQuery:
    """Valid events go to Parquet at path, others with their problem to quarantine.

    events has the columns of validate.SCHEMA. Delivery is at least once: a batch
    that is written again after a failure replaces its own folder, so readers see
    it once. Repeated event ids within the watermark are dropped.
    """
    marked = events.withColumn("problem", validate.first_problem()).withColumn("at", F.try_to_timestamp("ts"))
    once = marked.withWatermark("at", late).dropDuplicatesWithinWatermark(["event_id", "problem"])

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        batch.where("problem is null").drop("problem", "at").write.mode("overwrite").parquet(f"{path}/batch={number}")
        batch.where("problem is not null").drop("at").write.mode("overwrite").parquet(f"{quarantine}/batch={number}")
        batch.unpersist()

    return once.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "2 seconds"})).start()


def rollup(events: DataFrame, width: str = "1 hour", late: str = "1 hour", time_col: str = "at", keys: tuple[str, ...] = ("kind",)) -> DataFrame:
    """Counts by window of event time and keys; windows close `late` after the latest event."""
    grouped = events.withWatermark(time_col, late).groupBy(F.window(time_col, width).alias("window"), *keys)
    return grouped.agg(F.count("*").alias("events")).select("window.start", "window.end", *keys, "events")


def _take(limit: int, length: int):
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        start, count = state.get if state.exists else (None, 0)
        for pdf in frames:
            rows = pdf.sort_values(["micros", "id"])
            allowed = []
            for at in rows["micros"]:
                if start is None or at - start >= length:
                    start, count = int(at), 0
                allowed.append(count < limit)
                count += allowed[-1]
            yield pd.DataFrame({"id": rows["id"].to_numpy(), "subject": key[0], "allowed": allowed})
        state.update((start, count))
        state.setTimeoutDuration(max(1, length // 1000))

    return run


def limit_stream(requests: DataFrame, limit: int, seconds: float) -> DataFrame:
    """id, subject, allowed of a stream (id, subject, at): a window begins at a subject's first request, and denied ones do not count.

    State is one window for each subject; it goes when the window's length passes without a request.
    """
    own = requests.select(F.col("id").cast("long").alias("id"), F.col("subject").cast("string").alias("subject"), F.unix_micros("at").alias("micros"))
    return own.groupBy("subject").applyInPandasWithState(_take(limit, int(seconds * 1_000_000)), "id long, subject string, allowed boolean", "start long, count int", "append", GroupStateTimeout.ProcessingTimeTimeout)
