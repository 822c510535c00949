"""Fixed-window request limits for each subject, in batch.

A window begins at a subject's first request that no window holds; requests
beyond the limit are denied and do not count. Rows stream through a partition
sorted by subject and time, so memory is one window, whatever a subject sends.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _decide(limit: int, seconds: float):
    length = int(seconds * 1_000_000)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        subject, start, count = None, None, 0
        for pdf in batches:
            allowed, retry = [], []
            for who, at in zip(pdf["subject"], pdf["at"]):
                if who != subject or start is None or at - start >= length:
                    subject, start, count = who, at, 0
                ok = count < limit
                count += ok
                allowed.append(ok)
                retry.append(None if ok else max(1, -(-(start + length - at) // 1_000_000)))
            yield pd.DataFrame({"id": pdf["id"], "subject": pdf["subject"], "allowed": allowed, "retry_after": pd.array(retry, dtype="Int64")})

    return run


def limit_requests(requests: DataFrame, limit: int, seconds: float, id_col: str = "event_id", subject_col: str = "user_id", time_col: str = "ts") -> DataFrame:
    """id, subject, allowed, retry_after (whole seconds, null if allowed); ties in time go by id. Rows without a subject or time are left out."""
    own = requests.select(F.col(id_col).cast("long").alias("id"), F.col(subject_col).cast("string").alias("subject"), F.unix_micros(F.col(time_col).cast("timestamp")).alias("at"))
    ordered = own.where("id is not null and subject is not null and at is not null").repartition("subject").sortWithinPartitions("subject", "at", "id")
    return ordered.mapInPandas(_decide(limit, seconds), "id long, subject string, allowed boolean, retry_after long")
