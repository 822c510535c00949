"""Ranked lexical search: items by terms times terms by documents, in blocks.

Documents become blocks of postings of the items' terms, as one row each: the
documents of every term and how often they hold it. The blocks are a table, from which
the statistics of all documents are summed. Then each block meets the
items: an item's row of the product is merged from its terms' rows of integer impacts
(Gustavson's order), and the block's best documents of each item leave it. Spark keeps
the best of all blocks. Items are taken in slices of a bounded number of terms,
which are the only thing that is broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelens.llm import spans
from pagelens.sources.shared import materialize, quoted

ITEM_TERMS = 1_000_000  # terms of the items that are searched in one pass over the documents, but for one larger item
BLOCK_CHARS = 8_000_000

_BYTES = np.arange(256)
#: Bytes between terms: ASCII other than digits and letters.
SEPARATORS = (_BYTES < 0x30) | ((_BYTES > 0x39) & (_BYTES < 0x41)) | ((_BYTES > 0x5A) & (_BYTES < 0x61)) | ((_BYTES > 0x7A) & (_BYTES < 0x80))


def terms(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the terms of texts, A-Z lower-cased, and where each text's begin, the end last."""
    return spans.words([spans.utf8(x).lower() for x in texts], SEPARATORS)


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """item, term: distinct terms of the items, as hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, starts = terms(batch["text"].to_pylist())
            of = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
            yield pa.RecordBatch.from_arrays([batch["item"].take(pa.array(of)), pa.array(hashes.view(np.int64))], ["item", "term"])

    rows = items.select(quoted(id_col).cast("long").alias("item"), quoted(text_col).alias("text")).where("item is not null")
    return rows.mapInArrow(run, "item long, term long").distinct()


def _lists(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.asarray(ends, np.int32)), pa.array(values))


def postings(docs: DataFrame, vocabulary: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """Blocks of documents: docs with a term, tokens, ids, sizes; terms that occur (places in the sorted vocabulary), and for each its number of documents; their places and counts, term by term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["text"].to_pylist()
            for part in spans.chunks(texts, BLOCK_CHARS):
                hashes, starts = terms(texts[part])
                size = np.diff(starts)
                place = np.minimum(np.searchsorted(vocabulary, hashes), max(len(vocabulary) - 1, 0))
                hit = np.flatnonzero(vocabulary[place] == hashes) if len(vocabulary) else np.zeros(0, np.int64)
                of = np.repeat(np.arange(len(size)), size)[hit]
                keys, counts = np.unique(place[hit] * len(size) + of, return_counts=True)
                own, first = np.unique(keys // len(size), return_index=True)
                df = np.diff(np.r_[first, len(keys)])
                ids = batch["id"].slice(part.start, part.stop - part.start)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([int((size > 0).sum())], pa.int64()), pa.array([int(size.sum())], pa.int64()),
                        pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), _lists(size.astype(np.int32), [0, len(size)]),
                        _lists(own.astype(np.int32), [0, len(own)]), _lists(df.astype(np.int32), [0, len(df)]),
                        _lists((keys % len(size)).astype(np.int32), [0, len(keys)]), _lists(counts.astype(np.int32), [0, len(keys)]),
                    ],
                    ["docs", "tokens", "ids", "sizes", "terms", "dfs", "places", "counts"],
                )

    rows = docs.select(quoted(id_col).cast("long").alias("id"), quoted(text_col).alias("text"))
    return rows.mapInArrow(run, "docs long, tokens long, ids array<long>, sizes array<int>, terms array<int>, dfs array<int>, places array<int>, counts array<int>")


def best(scores: np.ndarray, ids: np.ndarray, missing: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores above 0, ties by smaller id, documents without id last."""
    at = np.flatnonzero(scores)
    if len(at) > k:
        least = np.partition(scores[at], len(at) - k)[len(at) - k]
        at = at[scores[at] >= least]
    return at[np.lexsort((ids[at], missing[at], -scores[at]))[:k]]


def _scored(items: np.ndarray, begins: np.ndarray, places: np.ndarray, weights: np.ndarray, n_docs: int, n_tokens: int, k: int):
    """Best documents of a block for each item. items, begins, places: their ids and terms as rows of a sparse matrix; weights by term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in range(batch.num_rows):
                ids, sizes, own, dfs, docs, counts = (batch[x][b].values for x in ("ids", "sizes", "terms", "dfs", "places", "counts"))
                missing, ids = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
                own, docs, tf = own.to_numpy(), docs.to_numpy(), counts.to_numpy().astype(np.int64)
                ends = np.r_[0, np.cumsum(dfs.to_numpy().astype(np.int64))]
                length = 100 - 90 + 90 * sizes.to_numpy().astype(np.int64) * n_docs // max(n_tokens, 1)
                impacts = np.repeat(weights[own], np.diff(ends)) * (1_000_000_000 * tf // (1000 * tf + 8 * length[docs]))
                row = np.full(len(weights) + 1, -1)
                row[own] = np.arange(len(own))
                scores = np.zeros(len(ids), np.int64)
                found: list[tuple[int, np.ndarray, np.ndarray]] = []
                for i, item in enumerate(items.tolist()):
                    scores[:] = 0
                    for r in row[places[begins[i] : begins[i + 1]]].tolist():
                        if r >= 0:
                            scores[docs[ends[r] : ends[r + 1]]] += impacts[ends[r] : ends[r + 1]]
                    at = best(scores, ids, missing, k)
                    if len(at):
                        found.append((item, at, scores[at]))
                if found:
                    at = np.concatenate([x for _, x, _ in found])
                    of = np.repeat(np.array([x for x, _, _ in found], np.int64), [len(x) for _, x, _ in found])
                    yield pa.RecordBatch.from_arrays([pa.array(of), pa.array(ids[at], mask=missing[at]), pa.array(np.concatenate([x for _, _, x in found]))], ["item", "doc", "score"])

    return run


def _slice(docs: DataFrame, own: list, id_col: str, text_col: str, k: int) -> DataFrame:
    spark = docs.sparkSession
    item, term = np.array([r["item"] for r in own], np.int64), np.array([r["term"] for r in own], np.int64).view(np.uint64)
    vocabulary, places = np.unique(term, return_inverse=True)
    order = np.lexsort((places, item))
    items, begins = np.unique(item[order], return_index=True)
    blocks = materialize(postings(docs, vocabulary, id_col, text_col), "postings")
    n_docs, n_tokens = (int(x or 0) for x in blocks.agg(F.sum("docs"), F.sum("tokens")).first())
    df = np.zeros(len(vocabulary), np.int64)
    for r in blocks.select(F.explode(F.arrays_zip("terms", "dfs")).alias("x")).groupBy("x.terms").agg(F.sum("x.dfs").alias("df")).collect():  # a slice's terms at most
        df[r["terms"]] = r["df"]
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
    shared = spark.sparkContext.broadcast((items, np.r_[begins, len(order)], places[order], weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _scored(*shared.value, n_docs, n_tokens, k)(batches)

    return blocks.select("ids", "sizes", "terms", "dfs", "places", "counts").mapInArrow(run, "item long, doc long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 10, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", item_terms_at_once: int = ITEM_TERMS) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: each item's k highest-scoring documents with a score above 0.

    Terms are maximal runs of digits, letters and bytes beyond ASCII, A-Z lower-cased;
    an item's terms count once each. They are compared by 64-bit hashes. Ids are
    integers; equal scores go by ascending id, documents without an id last (they count
    and may be found, with a null id). Items without an id or a term, or with a null text, have no
    rows; items of one id are one item, with the terms of all of them. Repeated documents each
    count and each have a rank. Other columns are not read. Empty tables
    give an empty result.
    """
    spark = docs.sparkSession
    pairs = materialize(item_terms(items, item_id, item_text), "item-terms")
    slices = max(1, -(-pairs.count() // item_terms_at_once))
    parts = []
    for i in range(slices):
        own = pairs.where(F.pmod(F.xxhash64("item"), F.lit(slices)) == i).collect()  # bounded by item_terms_at_once
        if own:
            parts.append(_slice(docs, own, doc_id, doc_text, k))
    found = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], "item long, doc long, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(F.col("item").alias("item_id"), "rank", F.col("doc").alias("doc_id"), "score")
