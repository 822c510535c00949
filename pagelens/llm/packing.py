"""Packing documents into windows by non-negative least squares on the length histogram.

Every document is encoded once, into a table in the shared folder. Whole windows
of long documents are sequences of their own; what is left of a document (less
than a window) is an item. The histogram of item lengths has fewer entries than
the window, so the driver can plan on it at any corpus size:

1. shallow combinations of two or three lengths that fill the window exactly,
2. how often to repeat each, by non-negative least squares against the
   histogram, rounded and held to what is there,
3. greedy exact fillings of what remains, largest length first,
4. what still remains is laid end to end and cut at window boundaries.

The plan gives ranges of ranks within a length. An item's rank is its rank in
its partition plus the counts of the partitions before, so no length, however
frequent, is gathered or sorted in one task.
"""

from __future__ import annotations

from array import array
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelens.llm.encoding import encoder
from pagelens.sources.shared import long_rows, materialize

WINDOW = 2048
END_ID = 1
POPULAR = 32  # lengths from which two of a triple come
OWN_WINDOWS = 40  # bits below the partition in ids of sequences that are one whole window


def _encode(files: tuple, window: int, end_id: int):
    end = array("I", [end_id]).tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        own = encoder(*files)
        seen = np.zeros(window, np.int64)
        wholes = 0
        for pdf in batches:
            for at in range(0, len(pdf), 512):
                rows = pdf.iloc[at : at + 512]
                ids = [own.encode(t or "") + end for t in rows["text"]]
                n = np.array([len(x) // 4 for x in ids], np.int64)
                rest = n % window
                rank, first = np.empty(len(n), np.int64), np.empty(len(n), np.int64)
                for i, r in enumerate(rest):
                    rank[i], first[i] = seen[r], wholes
                    seen[r] += 1
                    wholes += int(n[i]) // window
                yield pd.DataFrame({"doc_id": rows["doc_id"].to_numpy(), "part": part, "n": n, "rest": rest, "rank": rank, "first": first, "ids": ids})

    return run


def combinations(counts: np.ndarray, window: int) -> list[tuple[int, ...]]:
    """Pairs, and triples with two popular lengths, that fill the window from lengths that occur."""
    there = counts > 0
    out = [(a, window - a) for a in range(1, window // 2 + 1) if there[a] and there[window - a]]
    popular = sorted(int(x) for x in np.argsort(-counts, kind="stable")[:POPULAR] if counts[x] > 0)
    for i, a in enumerate(popular):
        for b in popular[i:]:
            c = window - a - b
            if c > 0 and there[c]:
                out.append(tuple(sorted((a, b, c))))
    return sorted(set(out))


def least_squares(combos: list[tuple[int, ...]], counts: np.ndarray, sweeps: int = 100) -> np.ndarray:
    """Repeat counts x >= 0 with the least squared distance of their lengths from counts, by coordinate descent."""
    x = np.zeros(len(combos))
    left = counts.astype(float)
    columns = [tuple(Counter(c).items()) for c in combos]
    norms = [sum(m * m for _, m in col) for col in columns]
    for _ in range(sweeps):
        most = 0.0
        for j, col in enumerate(columns):
            step = max(-x[j], sum(m * left[n] for n, m in col) / norms[j])
            if step:
                x[j] += step
                for n, m in col:
                    left[n] -= m * step
                most = max(most, abs(step))
        if most < 0.25:
            break
    return x


def plan(histogram: dict[int, int], window: int = WINDOW) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths that fill the window exactly, each with its repeat count; never more than the histogram has."""
    left = np.zeros(window + 1, np.int64)
    for n, c in histogram.items():
        left[n] = c
    left[0] = left[window] = 0
    out = []
    combos = combinations(left, window)
    x = least_squares(combos, left)
    for j in sorted(range(len(combos)), key=lambda j: (-x[j], combos[j])):
        need = Counter(combos[j])
        k = min(int(x[j] + 0.5), *(int(left[n]) // m for n, m in need.items()))
        if k > 0:
            out.append((combos[j], k))
            for n, m in need.items():
                left[n] -= k * m
    free = [n for n in range(1, window) if left[n] > 0]
    while free:
        gap, pattern, used = window, [], Counter()
        while gap:
            at = bisect_right(free, gap) - 1
            while at >= 0 and used[free[at]] >= left[free[at]]:
                at -= 1
            if at < 0:
                break
            pattern.append(free[at])
            used[free[at]] += 1
            gap -= free[at]
        k = min(int(left[n]) // m for n, m in used.items())
        if gap:  # no exact filling from the largest length: those items are cut later
            left[pattern[0]] = 0
        else:
            out.append((tuple(pattern), k))
            for n, m in used.items():
                left[n] -= k * m
        free = [n for n in free if left[n] > 0]
    return out


def _slots(patterns: list[tuple[tuple[int, ...], int]], histogram: dict[int, int], window: int) -> tuple[list[tuple], list[tuple], int]:
    """Slots (length, lowest rank, rank after, sequence of the lowest rank, offset); cut items (length, lowest rank, first position); the first sequence of cut items."""
    at: Counter = Counter()
    slots, sequence = [], 0
    for pattern, k in patterns:
        offset = 0
        for n in pattern:
            slots.append((n, at[n], at[n] + k, sequence, offset))
            at[n] += k
            offset += n
        sequence += k
    cut, position = [], 0
    for n in sorted(histogram):
        if n and histogram[n] > at[n]:
            cut.append((n, at[n], position))
            position += (histogram[n] - at[n]) * n
    return slots, cut, sequence


def pack(
    docs: DataFrame, tokenizer: str, ranks: str | None = None, pattern: str | None = None,
    id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = END_ID,
) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids, doc_tokens, sequence_id, offset.

    tokenizer is a file of the tokenizers library; ranks and pattern name the
    same vocabulary for tiktoken, which only makes it faster.
    ids holds a piece's ids as little-endian unsigned 32-bit integers. Each
    sequence is filled from offset 0 without gaps; at most one is not full.
    Sequence ids are unique, not dense. A null text counts as empty: one piece
    of one id. Null ids and repeated rows are packed like others. An empty table
    gives an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    long_rows(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    # Ids pass through pandas as strings, since it would turn whole numbers beside nulls into floats.
    encoded = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(
        _encode((tokenizer, ranks, pattern), window, end_id), "doc_id string, part int, n long, rest int, rank long, first long, ids binary"
    )
    encoded = materialize(encoded.withColumn("doc_id", F.col("doc_id").cast(kind)), "encoded", bucket_by="part")
    per_part = encoded.groupBy("part", "rest").agg(F.count("*").alias("c"))
    before = Window.partitionBy("rest").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    per_part = per_part.select("part", "rest", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("base"))
    histogram = {r["rest"]: r["c"] for r in encoded.groupBy("rest").agg(F.count("*").alias("c")).collect()}  # fewer rows than the window
    slots, cut, first_cut = _slots(plan(histogram, window), histogram, window)
    slots_df = spark.createDataFrame(slots, "rest int, low long, high long, sequence long, slot_offset long")
    cut_df = spark.createDataFrame(cut, "rest int, cut_low long, position long")

    # Joined by partition, by which the table is bucketed, so the ids are not shuffled.
    bases = per_part.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("rest", "base"))).alias("bases"))  # a window's lengths at most
    ranked = encoded.join(bases, "part").withColumn("base", F.col("bases")[F.col("rest")]).drop("bases")
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("base")).drop("base")
    # The plan has a bounded number of rows whatever the corpus: it is made from one histogram.
    on = (ranked["rest"] == slots_df["rest"]) & (ranked["rank"] >= slots_df["low"]) & (ranked["rank"] < slots_df["high"])
    placed = ranked.join(F.broadcast(slots_df), on, "left").drop(slots_df["rest"]).join(F.broadcast(cut_df), "rest", "left")

    done = F.col("n") - F.col("rest")
    own = F.transform(
        F.sequence(F.lit(0).cast("long"), (done / window).cast("long") - 1),
        lambda i: F.struct(
            (i * window).alias("start"),
            F.lit(window).cast("long").alias("length"),
            (F.shiftleft((F.col("part") + 1).cast("long"), OWN_WINDOWS) + F.col("first") + i).alias("sequence_id"),
            F.lit(0).cast("long").alias("offset"),
        ),
    )
    own = F.when(done > 0, own).otherwise(F.array().cast("array<struct<start:bigint,length:bigint,sequence_id:bigint,offset:bigint>>"))
    whole = F.struct(done.alias("start"), F.col("rest").cast("long").alias("length"), (F.col("sequence") + F.col("rank") - F.col("low")).alias("sequence_id"), F.col("slot_offset").alias("offset"))
    begin = F.col("position") + (F.col("rank") - F.col("cut_low")) * F.col("rest")
    room = window - begin % window
    head = F.least(room, F.col("rest").cast("long"))
    one = F.struct(done.alias("start"), head.alias("length"), (F.floor(begin / window) + first_cut).alias("sequence_id"), (begin % window).alias("offset"))
    two = F.struct((done + head).alias("start"), (F.col("rest") - head).alias("length"), (F.floor(begin / window) + first_cut + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    none = F.array().cast("array<struct<start:bigint,length:bigint,sequence_id:bigint,offset:bigint>>")
    last = F.when(F.col("rest") == 0, none).when(F.col("low").isNotNull(), F.array(whole)).when(F.col("rest") > head, F.array(one, two)).otherwise(F.array(one))
    pieces = placed.select("doc_id", "n", "ids", F.explode(F.concat(own, last)).alias("p"))
    return pieces.select(
        "doc_id",
        "p.start",
        "p.length",
        F.expr("substring(ids, cast(p.start * 4 + 1 as int), cast(p.length * 4 as int))").alias("ids"),
        F.col("n").alias("doc_tokens"),
        "p.sequence_id",
        "p.offset",
    )
