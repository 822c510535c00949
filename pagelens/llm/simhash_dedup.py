"""SimHash near-duplicates: tiled exact comparison of all fingerprints.

Fingerprints are made in Arrow batches. Equal fingerprints are one class from
then on, however many documents share it. Classes are dealt into tiles by the
bit counts of their two halves. Two tiles are compared only if these counts are
near enough: a pair whose half counts differ by d bits in sum has a distance of
at least d. Within a tile pair, groups with the same counts of the four 16-bit
quarters are skipped by the same bound; the rest is compared with numpy
exclusive-or and bit counts, so no pair within the radius is missed.
A tile pair reports no pairs but at most one row for each fingerprint, its least
connected fingerprint, so large groups of near copies stay linear.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from pagelens.llm.graph import connected_components, settle
from pagelens.sources.shared import long_rows, materialize, quoted

SHINGLE_WORDS = 4
RADIUS = 4
SEED = 42
TILE = 8192


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash of word shingles as a signed integer; 0 if there is no word.

    Only A-Z are lower-cased and only ASCII white space separates words, which
    is what bytes.lower and bytes.split do on UTF-8. Each digest is taken on the
    UTF-8 of the space-joined shingle, repeats included.
    """
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    digest = xxhash.xxh64_intdigest
    shingles = map(b" ".join, zip(*(w[i:] for i in range(words)))) if len(w) > words else (b" ".join(w),)
    h = np.array([digest(s, SEED) for s in shingles], dtype=np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 65536):
        ones += np.unpackbits(h[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(ones * 2 > len(h), bitorder="little")
    return int(bits.view(np.int64)[0])


@F.pandas_udf(LongType())
def fingerprint_udf(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in texts:
        yield pd.Series([fingerprint(x) for x in s], dtype="int64")


def _quarters(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x.view(np.uint16).reshape(-1, 4)).astype(np.int16)


def _grouped(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """x ordered by its quarter counts; each group's counts, start and end."""
    q = _quarters(x)
    key = ((q[:, 0].astype(np.int64) * 17 + q[:, 1]) * 17 + q[:, 2]) * 17 + q[:, 3]
    order = np.argsort(key, kind="stable")
    x, key, q = x[order], key[order], q[order]
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return x, q[start], start, np.r_[start[1:], len(x)]


def tile_links(a: np.ndarray, b: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows (fingerprint, least connected fingerprint) within a tile (b None) or between two."""
    a, qa, sa, ea = _grouped(np.ascontiguousarray(a))
    if b is None:
        b, qb, sb, eb, base = a, qa, sa, ea, 0
        nodes = a
    else:
        b, qb, sb, eb = _grouped(np.ascontiguousarray(b))
        base = len(a)
        nodes = np.concatenate([a, b])
    parent = np.arange(len(nodes))
    for g in range(len(sa)):
        near = np.flatnonzero(np.abs(qb - qa[g]).sum(axis=1) <= radius)
        if base == 0:
            near = near[near >= g]
        if not len(near):
            continue
        at = np.concatenate([np.arange(sb[i], eb[i]) for i in near])
        other = b[at]
        step = max(1, 2_000_000 // len(at))
        for lo in range(sa[g], ea[g], step):
            hi = min(lo + step, ea[g])
            i, j = np.nonzero(np.bitwise_count(a[lo:hi, None] ^ other[None, :]) <= radius)
            if len(i):
                parent = settle(parent, i + lo, at[j] + base)
    moved = parent != np.arange(len(nodes))
    return nodes[moved], nodes[parent[moved]]


def _compare(radius: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for same, a, b in zip(pdf["same"], pdf["a"], pdf["b"]):
                u, v = tile_links(np.asarray(a, np.int64).view(np.uint64), None if same else np.asarray(b, np.int64).view(np.uint64), radius)
                if len(u):
                    yield pd.DataFrame({"u": u.view(np.int64), "v": v.view(np.int64)})

    return run


def linked_fingerprints(classes: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Edges u, v that connect exactly the distinct fingerprints (column fp) linked within the radius."""
    keyed = classes.select(
        "fp",
        F.bit_count(F.shiftrightunsigned("fp", 32)).alias("hi"),
        F.bit_count(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))).alias("lo"),
    )
    per_key = keyed.groupBy("hi", "lo").agg(F.ceil(F.count("*") / tile).cast("int").alias("chunks"))  # at most 33 * 33 rows
    tiles = (
        keyed.join(F.broadcast(per_key), ["hi", "lo"])
        .withColumn("chunk", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
        .groupBy("hi", "lo", "chunk")
        .agg(F.collect_list("fp").alias("fps"))
    )
    tiles = materialize(tiles, "tiles")
    ahead = [(h, w) for h in range(radius + 1) for w in range(-radius, radius + 1) if h + abs(w) <= radius and (h, w) >= (0, 0)]
    steps = F.array(*[F.struct(F.lit(h).alias("h"), F.lit(w).alias("w")) for h, w in ahead])
    left = tiles.select("hi", "lo", "chunk", F.col("fps").alias("a"), F.explode(steps).alias("d"))
    left = left.select(F.col("hi").alias("ahi"), F.col("lo").alias("alo"), F.col("chunk").alias("achunk"), "a", (F.col("hi") + F.col("d.h")).alias("hi"), (F.col("lo") + F.col("d.w")).alias("lo"))
    same_key = (F.col("ahi") == F.col("hi")) & (F.col("alo") == F.col("lo"))
    same = same_key & (F.col("achunk") == F.col("chunk"))
    pairs = (
        left.join(tiles.select("hi", "lo", "chunk", F.col("fps").alias("b")), ["hi", "lo"])
        .where(~same_key | (F.col("achunk") <= F.col("chunk")))
        .select(same.alias("same"), "a", F.when(~same, F.col("b")).alias("b"), F.xxhash64("ahi", "alo", "achunk", "hi", "lo", "chunk").alias("pair"))
        .repartition("pair")  # the join only brings tiles together; the pairs of the fullest counts are compared in all tasks
        .drop("pair")
    )
    return pairs.mapInPandas(_compare(radius), "u long, v long")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """One row for each input row: doc_id, fp (signed 64 bits), component_id.

    component_id is the smallest id that links reach, the row's own included.
    A null text counts as empty, and all texts without a word have fingerprint
    zero and link like others. Null ids are kept, with a component of the least
    id that is not null (null if there is none). Repeated rows are kept as they
    are. An empty table gives an empty result. Other columns are not read.
    """
    long_rows(docs.sparkSession)
    prints = materialize(docs.select(F.col(id_col).alias("doc_id"), fingerprint_udf(F.col(text_col)).alias("fp")), "fingerprints")
    classes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    roots = connected_components(linked_fingerprints(classes, radius, tile))
    rooted = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    labelled = rooted.join(least, "root").select("fp", "component_id")
    return prints.join(labelled, "fp").select("doc_id", "fp", "component_id")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """Keep one row of each group, that of the smallest id, and of the first row if several have it.

    All columns of docs come back as they are, whatever their names. A null id
    counts as the smallest. Repeated rows are one group.
    """
    key = F.struct(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("uid"))
    numbered = materialize(docs.select(F.struct(*map(quoted, docs.columns)).alias("row"), key.alias("key"), quoted(text_col).alias("text")), "numbered")
    grouped = simhash_components(numbered.select("key", "text"), "key", "text", radius)
    kept = grouped.where(F.col("doc_id.uid") == F.col("component_id.uid")).select(F.col("doc_id.uid").alias("uid"))
    return numbered.withColumn("uid", F.col("key.uid")).join(kept, "uid", "left_semi").select("row.*")
