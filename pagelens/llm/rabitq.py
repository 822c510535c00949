"""Approximate nearest neighbours by randomly rotated one-bit codes.

A row's residual from a centre is rotated and kept as one bit a dimension, with
two correction scalars: its norm and its inner product with its own code. A query
is rotated and cut into PLANES bit planes; counts of the bits that a plane and a
code share give their inner product, without unpacking codes. Over the
second scalar it estimates that with the row, and the scalars bound the error: with
EPSILON it is exceeded rarely. A row is reranked by its exact score if its upper bound reaches the
query's kth lower bound in the block or its kth score within a sample.
"""

from __future__ import annotations

import io

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.llm import vectors
from pagelens.sources.shared import materialize

EPSILON = 2.5
PLANES = 6  # bits of a query's rotated components
SEED = 20240601


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng([seed, dim]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def _dump(**arrays) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _load(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data)) as f:
        return {k: f[k] for k in f.files}


def words(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as rows of 64-bit numbers, filled up with zeros."""
    packed = np.packbits(bits, axis=1)
    return np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8))).view(np.uint64)


def encode(ids: np.ndarray, matrix: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> bytes:
    """A block's codes, correction scalars and original vectors."""
    rest = matrix - centre
    norm = np.sqrt((rest**2).sum(axis=1))
    turned = (rest / np.where(norm > 0, norm, 1.0)[:, None]) @ turn
    fit = np.abs(turned).sum(axis=1) / np.sqrt(matrix.shape[1])
    return _dump(ids=ids, codes=words(turned > 0), norm=norm, fit=np.where(norm > 0, fit, 1.0), vectors=matrix)


def planes(queries: np.ndarray, turn: np.ndarray) -> dict[str, np.ndarray]:
    """Rotated queries in whole steps from their least component: bit planes, step, least, and the sum of what the steps leave out."""
    turned = queries @ turn
    low = turned.min(axis=1)
    step = np.maximum((turned.max(axis=1) - low) / (2**PLANES - 1), 1e-300)
    level = np.rint((turned - low[:, None]) / step[:, None]).astype(np.int64)
    cut = np.abs(turned - low[:, None] - level * step[:, None]).sum(axis=1)
    return {"planes": np.stack([words((level >> j) & 1 == 1) for j in range(PLANES)]), "step": step, "low": low, "total": turned.sum(axis=1), "cut": cut}


def estimate(block: dict[str, np.ndarray], query: dict[str, np.ndarray], centre: np.ndarray, epsilon: float) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products (queries x rows) and the bounds of their errors."""
    queries, codes = query["vectors"], block["codes"]
    dim = queries.shape[1]
    ones = np.bitwise_count(codes).sum(axis=1, dtype=np.int64)
    shared = np.empty((len(queries), len(codes)))
    for i in range(len(queries)):
        counts = np.zeros(len(codes), np.int64)
        for j in range(PLANES):
            counts += np.bitwise_count(codes & query["planes"][j, i]).sum(axis=1, dtype=np.int64) << j
        shared[i] = query["low"][i] * ones + query["step"][i] * counts
    signs = (2.0 * shared - query["total"][:, None]) / np.sqrt(dim)
    value = signs * (block["norm"] / block["fit"])[None, :] + (queries @ centre)[:, None]
    spread = block["norm"] * np.sqrt(np.maximum(1.0 - block["fit"] ** 2, 0.0)) / block["fit"] / np.sqrt(max(1, dim - 1))
    error = epsilon * np.sqrt((queries**2).sum(axis=1))[:, None] * spread[None, :] + 2.0 * query["cut"][:, None] / np.sqrt(dim) * (block["norm"] / block["fit"])[None, :]
    return value, error + 1e-9 * (1.0 + np.abs(value))


def compare(block: dict, query: dict, k: int, centre: np.ndarray, epsilon: float) -> tuple:
    """Exact scores of the rows of a block that the bounds leave to each query, its best k."""
    value, error = estimate(block, query, centre, epsilon)
    own = query["ids"][:, None] == block["ids"][None, :]
    value[own] = -np.inf
    least = query["bound"]
    if value.shape[1] > k:
        least = np.maximum(least, np.partition(value - error, value.shape[1] - k, axis=1)[:, value.shape[1] - k])
    keep = (value + error >= least[:, None]) & ~own
    out: list[tuple] = []
    for i in range(len(keep)):
        rows = np.flatnonzero(keep[i])
        if len(rows):
            s = (block["vectors"][rows] * query["vectors"][i]).sum(axis=1)  # row by row, so equal vectors score the same wherever they stand
            best = np.lexsort((block["ids"][rows], -s))[:k]
            out.append((np.full(len(best), query["ids"][i]), block["ids"][rows[best]], s[best]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*out))


def nearest(table: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", epsilon: float = EPSILON) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest found rows by inner product, scores exact.

    is_query is a condition on the column id. Rows with a null id, a vector that
    is null, empty or zero, or a component that is null or not finite take no
    part; vectors of different lengths are not compared. A query with fewer
    candidates gets all of them; ties go to the smaller id. Rows with the query's
    own id are not its candidates; of repeated query ids the least vector counts,
    and repeated candidates may each appear. An empty table gives an empty
    result. Only the centre is fitted on a sample (of vectors.SAMPLE_ROWS rows);
    every row is indexed.
    """
    rows = materialize(vectors.usable(table, id_col, vector_col).where(F.exists("v", lambda x: x != 0)), "vectors")
    taken = vectors.sample(rows)
    fitted = {d: (m.mean(axis=0), rotation(d)) for d, (_, m) in taken.items()}  # one rotation for each length of vectors
    sampled = table.sparkSession.sparkContext.broadcast((taken, fitted))
    asked = rows.where(is_query).groupBy("id").agg(F.min("v").alias("v"))

    def of(dim: int) -> tuple[np.ndarray, np.ndarray]:
        return sampled.value[1].get(dim) or (np.zeros(dim), rotation(dim))  # a length that the sample missed

    def query_block(ids: np.ndarray, matrix: np.ndarray) -> bytes:
        return _dump(ids=ids, vectors=matrix, bound=vectors.lower_bounds(ids, matrix, sampled.value[0], k), **planes(matrix, of(matrix.shape[1])[1]))

    def pair(data: bytes, query: bytes) -> tuple:
        q = _load(query)
        return compare(_load(data), q, k, of(q["vectors"].shape[1])[0], epsilon)

    data = materialize(vectors.blocks(rows, lambda ids, m: encode(ids, m, *of(m.shape[1])), vectors.BLOCK_ROWS), "codes")
    queries = materialize(vectors.blocks(asked, query_block, vectors.QUERY_ROWS), "query-vectors")
    return vectors.search(data, queries, pair, k, "double")
