"""Byte-level BPE over a corpus: a global shuffle of distinct words.

Encoding has four steps. Each block of a partition splits its texts into
pre-tokens and keeps, for each position, the number of the word in the block's
own dictionary. The dictionaries' words go to buckets by their hash, where each
distinct word is encoded once. Their ids return to the blocks, and each block
puts the ids in the order of the positions. A word is sent at most once for each
block, however often it occurs, so frequent words make no hot key, and a bucket
is read as a stream.

Decoding joins the table of token bytes to the ids by position: a broadcast join,
as the table has as many rows as the vocabulary, whatever the corpus.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
import tiktoken
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.sources.shared import long_rows, materialize

BLOCK_CHARS = 12_000_000  # characters of a block, at most, but for one longer text
PAGE_TOKENS = 1_000_000  # positions in one row of a block, at most, but for one longer text
BUCKETS = 256  # of words, at least
WORDS_KEPT = 500_000  # words of a bucket whose ids are kept at hand; buckets grow in number with the session's shuffle partitions

_OTHER_SPACES = re.compile(r" (?:\s|(?<=\s ))")


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ids of a rank file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _pack(values: np.ndarray) -> bytes:
    """Unsigned integers, bytes of the same weight together, compressed."""
    planes = np.ascontiguousarray(values.astype("<u4")).view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpack(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").ravel()


class _Block:
    """Positions of a block's texts by the numbers of its own words."""

    def __init__(self, pattern: regex.Pattern):
        self.pattern = pattern
        self.words: dict[str, int] = {}
        self.chunks: dict[str, bytes] = {}
        self.ids: list = []
        self.texts: list[bytes] = []
        self.chars = 0

    def _split(self, text: str) -> bytes:
        words = self.words
        return array("I", [words.setdefault(w, len(words)) for w in self.pattern.findall(text)]).tobytes()

    def add(self, doc_id, text: str) -> None:
        """A space between two characters that are not white space always begins a pre-token, so each chunk between them is split once."""
        self.ids.append(doc_id)
        self.chars += len(text)
        if not text or text[0] == " " or text[-1] == " " or _OTHER_SPACES.search(text):
            self.texts.append(self._split(text))
            return
        head, *rest = text.split(" ")
        chunks = self.chunks
        out = [self._split(head)]
        for x in rest:
            numbers = chunks.get(x)
            if numbers is None:
                numbers = chunks[x] = self._split(" " + x)
            out.append(numbers)
        self.texts.append(b"".join(out))

    def rows(self, block: int, buckets: int) -> Iterator[pd.DataFrame]:
        sizes = [len(t) // 4 for t in self.texts]
        numbers = np.frombuffer(b"".join(self.texts), "<u4")
        self.texts, self.chunks = [], {}
        order = np.argsort(-np.bincount(numbers, minlength=len(self.words)), kind="stable")  # frequent words get small numbers
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        lo, at = 0, 0
        while lo < len(sizes):
            hi, n = lo, 0
            while hi < len(sizes) and (hi == lo or n + sizes[hi] <= PAGE_TOKENS):
                n += sizes[hi]
                hi += 1
            yield pd.DataFrame({"block": [block], "bucket": [-1], "doc_ids": [self.ids[lo:hi]], "sizes": [sizes[lo:hi]], "data": [_pack(rank[numbers[at : at + n]])], "words": [None], "lengths": [None]})
            lo, at = hi, at + n
        words = list(self.words)
        to = np.fromiter((xxhash.xxh32_intdigest(w.encode("utf-8", "surrogatepass")) for w in words), np.uint32, len(words)) % buckets
        compress = zstandard.ZstdCompressor(level=1).compress
        by = [np.sort(rank[to == b]) for b in range(buckets)]
        for b, ranks in enumerate(by):
            if len(ranks):
                own = [words[order[r]] for r in ranks]
                joined = "".join(own).encode("utf-8", "surrogatepass")
                yield pd.DataFrame({"block": [block], "bucket": [b], "doc_ids": [None], "sizes": [None], "data": [_pack(np.diff(ranks, prepend=np.uint32(0)))], "words": [compress(joined)], "lengths": [_pack(np.fromiter(map(len, own), np.uint32, len(own)))]})


def _index(pattern: str, buckets: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        compiled = regex.compile(pattern)
        block, n = _Block(compiled), 0
        first = TaskContext.get().partitionId() << 32
        for pdf in batches:
            for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
                text = text or ""
                if block.ids and block.chars + len(text) > BLOCK_CHARS:
                    yield from block.rows(first + n, buckets)
                    block, n = _Block(compiled), n + 1
                block.add(doc_id, text)
        if block.ids:
            yield from block.rows(first + n, buckets)

    return run


def _encode_words(ranks):
    """Encode each distinct word of the buckets once; one row of ids for each block and bucket."""
    pattern_all = r"(?s:.+)"  # a word is one pre-token

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoding = tiktoken.Encoding("words", pat_str=pattern_all, mergeable_ranks=ranks.value, special_tokens={})
        known: dict[str, bytes] = {}
        now = None
        for pdf in batches:
            for block, bucket, data, packed, lengths in zip(pdf["block"], pdf["bucket"], pdf["data"], pdf["words"], pdf["lengths"]):
                joined = zstandard.ZstdDecompressor().decompress(packed).decode("utf-8", "surrogatepass")
                ends = np.cumsum(_unpack(lengths), dtype=np.int64).tolist()
                words = [joined[lo:hi] for lo, hi in zip([0, *ends], ends)]
                if bucket != now or len(known) > WORDS_KEPT:
                    known, now = {}, bucket
                ids = []
                for w in words:
                    x = known.get(w)
                    if x is None:
                        x = known[w] = array("I", encoding.encode_ordinary(w)).tobytes()
                    ids.append(x)
                sizes = np.fromiter(map(len, ids), np.uint32, len(ids)) // 4
                yield pd.DataFrame({"block": [block], "ranks": [data], "sizes": [_pack(sizes)], "ids": [_pack(np.frombuffer(b"".join(ids), "<u4"))]})

    return run


def gather(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """values[start[i] : start[i] + size[i]] for all i, one after another."""
    end = np.cumsum(size)
    return values[np.arange(int(end[-1]) if len(end) else 0) + np.repeat(start - (end - size), size)]


def _assemble(pages: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
    """Ids of a block's documents in the order of their positions."""
    ranks = [np.cumsum(_unpack(x), dtype=np.int64) for x in words["ranks"]]
    sizes = [_unpack(x).astype(np.int64) for x in words["sizes"]]
    ids = [_unpack(x) for x in words["ids"]]
    flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
    n = sum(map(len, ranks))
    size, start = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if n:
        all_ranks, all_sizes = np.concatenate(ranks), np.concatenate(sizes)
        size[all_ranks] = all_sizes
        start[all_ranks] = np.cumsum(all_sizes) - all_sizes
    doc_ids, out = [], []
    for own, counts, data in zip(pages["doc_ids"], pages["sizes"], pages["data"]):
        numbers = _unpack(data)
        tokens = gather(flat, start[numbers], size[numbers])
        ends = np.cumsum(np.r_[0, size[numbers]])[np.cumsum(counts)] if len(counts) else []
        lo = 0
        for doc_id, hi in zip(own, ends):
            doc_ids.append(doc_id)
            out.append(tokens[lo:hi].astype("<u4").tobytes())
            lo = hi
    return pd.DataFrame({"doc_id": pd.Series(doc_ids, dtype=object), "ids": pd.Series(out, dtype=object)})


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (little-endian unsigned 32-bit integers) of every whole text.

    Null texts count as empty and have no id. Null ids and repeated rows stay.
    Texts may be of any length that fits a row; one longer than a block has a
    block of its own. An empty table gives an empty result. Other columns are
    not read.
    """
    spark = docs.sparkSession
    long_rows(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    ranks = spark.sparkContext.broadcast(load_ranks(ranks_path))  # as large as the vocabulary
    blocks = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(
        _index(pattern, max(BUCKETS, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))), "block long, bucket int, doc_ids array<string>, sizes array<int>, data binary, words binary, lengths binary"
    )
    blocks = materialize(blocks, "blocks", bucket_by="block")  # the pages need no shuffle to meet their words again
    words = blocks.where("bucket >= 0").select("block", "bucket", "data", "words", "lengths").repartition("bucket").sortWithinPartitions("bucket")
    words = words.mapInPandas(_encode_words(ranks), "block long, ranks binary, sizes binary, ids binary")
    pages = blocks.where("bucket < 0").select("block", "doc_ids", "sizes", "data")
    out = pages.groupBy("block").cogroup(words.groupBy("block")).applyInPandas(_assemble, "doc_id string, ids binary")
    return out.select(F.col("doc_id").cast(kind).alias("doc_id"), "ids")


def decode(encoded: DataFrame, ranks_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """encoded with the bytes of its ids added; null ids give null, no id gives no byte.

    An id outside the vocabulary is an error. out_col must not be a column of encoded.
    """
    table = load_ranks(ranks_path)
    by_id = sorted((i, b) for b, i in table.items())
    size = np.zeros(by_id[-1][0] + 1, np.int64)
    for i, b in by_id:
        size[i] = len(b)
    shared = encoded.sparkSession.sparkContext.broadcast((np.frombuffer(b"".join(b for _, b in by_id), np.uint8), np.cumsum(size) - size, size))

    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        values, start, size = shared.value
        for s in series:
            out = []
            for x in s:
                ids = None if x is None else np.frombuffer(x, "<u4")
                if ids is not None and len(ids) and not size[ids].all():
                    raise ValueError("an id outside the vocabulary")
                out.append(None if ids is None else gather(values, start[ids], size[ids]).tobytes())
            yield pd.Series(out, dtype=object)

    run.__annotations__ = {"series": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return encoded.withColumn(out_col, F.pandas_udf(run, "binary")(F.col(ids_col)))
