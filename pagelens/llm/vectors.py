"""Vector tables as blocks: what the vector searches share.

A search compares a stated query set with all rows, block by block. Rows of data
and of queries are packed into blocks of bounded size in Arrow batches; a block
pair is one row of work, and only each query's best few of each block leave it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 8192
QUERY_ROWS = 1024
SAMPLE_ROWS = 4096  # rows whose exact scores give each query its first lower bound


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id and v (array of double) of the rows that take part: no null, no component that is null or not finite."""
    v = F.transform(vector_col, lambda x: x.cast("double"))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null")
    return rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & (F.size("v") > 0))


def _matrix(values) -> np.ndarray:
    return np.array([np.asarray(x) for x in values])


def blocks(rows: DataFrame, build: Callable[[np.ndarray, np.ndarray], bytes], block_rows: int) -> DataFrame:
    """Rows (id, v) packed by build(ids, matrix), of one dimension each: dim int, data binary."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list] = {}
        for pdf in batches:
            for i, v in zip(pdf["id"].tolist(), pdf["v"]):
                own = held.setdefault(len(v), [])
                own.append((i, v))
                if len(own) >= block_rows:
                    yield packed(held.pop(len(v)))
        for own in held.values():
            yield packed(own)

    def packed(own: list) -> pd.DataFrame:
        ids = np.array([i for i, _ in own], np.int64)
        matrix = _matrix(v for _, v in own)
        return pd.DataFrame({"dim": [matrix.shape[1]], "data": [build(ids, matrix)]})

    return rows.mapInPandas(run, "dim int, data binary")


def sample(rows: DataFrame, n: int = SAMPLE_ROWS) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """At most n rows, those with the smallest hashes of their ids: ids and matrix by dimension."""
    picked = rows.orderBy(F.xxhash64("id"), "id").limit(n).collect()
    by: dict[int, list] = {}
    for r in picked:
        by.setdefault(len(r["v"]), []).append(r)
    return {d: (np.array([r["id"] for r in own], np.int64), _matrix(r["v"] for r in own)) for d, own in by.items()}


def lower_bounds(ids: np.ndarray, matrix: np.ndarray, sampled: dict, k: int) -> np.ndarray:
    """Each query's kth best score within the sample, its own id left out and a rounding error taken off; minus infinity if the sample is too small."""
    out = np.full(len(ids), -np.inf)
    if matrix.shape[1] in sampled:
        own, values = sampled[matrix.shape[1]]
        if len(own) > k:
            scores = matrix.astype(float) @ values.astype(float).T
            scores[ids[:, None] == own[None, :]] = -np.inf
            out = np.partition(scores, len(own) - k, axis=1)[:, len(own) - k]
            out -= np.abs(matrix.astype(float)).sum(axis=1) * np.abs(values).max() * 2.0**-44  # products are rounded in another order elsewhere
    return out


def search(data: DataFrame, queries: DataFrame, compare: Callable[[bytes, bytes], tuple], k: int, score_type: str) -> DataFrame:
    """Best k of every query over all block pairs: query_id, rank, vec_id, score.

    compare(data block, query block) gives query ids, vector ids and scores. The
    product is one of blocks: the stated query set against all rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for d, q, x, y in zip(pdf["data"], pdf["query"], pdf["dim"], pdf["qdim"]):
                if x == y:
                    a, b, s = compare(d, q)
                    yield pd.DataFrame({"query_id": a, "vec_id": b, "score": s})

    pairs = data.crossJoin(queries.select(F.col("dim").alias("qdim"), F.col("data").alias("query")))
    found = pairs.mapInPandas(run, f"query_id long, vec_id long, score {score_type}")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
