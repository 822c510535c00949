"""Runs of words that repeat with a period, found in each text's suffix automaton.

The end positions of a state are its children's, merged from the smaller set into
the larger one in order of length. Whatever two positions become neighbours then, at a
distance of the state's length or less, end equal words that meet or overlap: a
square. It is extended to both sides as long as the period holds, and kept if it is
long enough and has no shorter period. For a run [s, e] of period q and exponent 4, e
and e - q first meet in a state of length 3 q or more, and no position between them can
end the same words there, as the run would have a shorter period; so none is missed.

Only stretches of words that can hold a run go through an automaton: of a run of
LEAST words and exponent 3 or more, each three neighbouring words occur again within the
same stretch. This looks at hashes of three words, and leaves out no run.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.llm import spans
from pagelens.sources.shared import quoted

LEAST, EXPONENT = 6, 4  # words of a run at least, and periods

_G = np.uint64(0x9E3779B97F4A7C15)


def automaton(symbols: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Length, suffix link and own end position (-1 for copies) of the states of the suffix automaton; state 0 is the root."""
    after: list[dict[int, int]] = [{}]
    length, link, own = [0], [-1], [-1]
    last = 0
    for at, x in enumerate(symbols):
        now = len(length)
        length.append(at + 1)
        link.append(0)
        own.append(at)
        after.append({})
        p = last
        while p >= 0 and x not in after[p]:
            after[p][x] = now
            p = link[p]
        if p >= 0:
            q = after[p][x]
            if length[q] != length[p] + 1:
                copy = len(length)
                length.append(length[p] + 1)
                link.append(link[q])
                own.append(-1)
                after.append(dict(after[q]))
                while p >= 0 and after[p].get(x) == q:
                    after[p][x] = copy
                    p = link[p]
                link[q] = copy
                q = copy
            link[now] = q
        last = now
    return length, link, own


def squares(symbols: list[int]) -> Iterator[tuple[int, int]]:
    """End position and period of squares; each run of exponent 4 holds one of its period."""
    length, link, own = automaton(symbols)
    # Positions count down, as a state's own one is its first: it is put at the end of a list.
    ends: list[list[int] | None] = [[-x] if x >= 0 else None for x in own]
    for state in sorted(range(1, len(length)), key=length.__getitem__, reverse=True):
        up, small = link[state], ends[state]
        ends[state] = None
        if not up:
            continue
        large, most = ends[up], length[up]
        if large is None:
            ends[up] = small
            continue
        if len(large) < len(small):
            small, large = large, small
        for x in small:
            i = bisect_left(large, x)
            if i and x - large[i - 1] <= most:
                yield -large[i - 1], x - large[i - 1]
            if i < len(large) and large[i] - x <= most:
                yield -x, large[i] - x
            large.insert(i, x)
        ends[up] = large


def _shorter(symbols: list[int], start: int, period: int) -> bool:
    """Whether a run that holds two periods at least has a shorter one, which then divides it."""
    block = symbols[start : start + period]
    left, p = period, 2
    while left > 1:
        if p * p > left:
            p = left
        if left % p:
            p += 1
            continue
        step = period // p
        if block[step:] == block[:-step]:
            return True
        while left % p == 0:
            left //= p
    return False


def runs_of(symbols: list[int], least: int = LEAST, exponent: int = EXPONENT) -> list[tuple[int, int, int]]:
    """Start, length and smallest period of the runs of a sequence, by start and period."""
    n, out = len(symbols), []
    known: dict[int, list[tuple[int, int]]] = {}  # by period, the places that equal the one a period before, as ordered intervals
    for end, period in squares(symbols):
        found = known.setdefault(period, [])
        i = bisect_left(found, (end + 1,))
        if i and found[i - 1][1] >= end:
            continue
        lo = hi = end
        while hi + 1 < n and symbols[hi + 1] == symbols[hi + 1 - period]:
            hi += 1
        while lo > period and symbols[lo - 1] == symbols[lo - 1 - period]:
            lo -= 1
        found.insert(i, (lo, hi))
        start, length = lo - period, hi - lo + 1 + period
        if length >= max(least, exponent * period) and not _shorter(symbols, start, period):
            out.append((start, length, period))
    return sorted(out, key=lambda r: (r[0], r[2]))


def stretches(words: np.ndarray, starts: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """First and last words of the stretches that can hold runs of exponent 3 or more.

    words: hashes; starts: where each text begins, the end last.
    """
    size = np.diff(starts)
    of = np.repeat(np.arange(len(size)), np.maximum(size - 2, 0))
    at = np.arange(len(of)) - np.repeat(np.cumsum(np.maximum(size - 2, 0)) - np.maximum(size - 2, 0) - starts[:-1], np.maximum(size - 2, 0))
    triple = spans.mix(words[at] * np.uint64(3) + spans.mix(words[at + 1] * np.uint64(5) + spans.mix(words[at + 2] + _G)))
    while True:
        keys = spans.mix(triple + spans.mix(of.astype(np.uint64)))
        order = np.argsort(keys, kind="stable")
        same = keys[order[1:]] == keys[order[:-1]]
        again = np.zeros(len(keys), bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        triple, of, at = triple[again], of[again], at[again]
        opens = np.flatnonzero(np.r_[True, (np.diff(at) != 1) | (np.diff(of) != 0)][: len(at)])
        long = np.diff(np.r_[opens, len(at)])
        keep = np.repeat(long >= least - 2, long)
        if again.all() and keep.all():
            return at[opens], at[opens + long - 1] + 2
        of = np.repeat(np.arange(len(opens)), long)[keep]
        triple, at = triple[keep], at[keep]


def text_runs(texts: list[str | None], least: int = LEAST, exponent: int = EXPONENT) -> Iterator[tuple[list[tuple[int, int, int]], bytes]]:
    """Each text's runs, and its words joined by one space without those that repeat in a run."""
    raw = [spans.utf8(x) for x in texts]
    words, starts = spans.words(raw)
    first, last = stretches(words, starts, least)
    cut = np.searchsorted(first, starts)
    for i, text in enumerate(raw):
        own, found = text.split(), []
        for lo, hi in zip((first[cut[i] : cut[i + 1]] - starts[i]).tolist(), (last[cut[i] : cut[i + 1]] - starts[i]).tolist()):
            numbers: dict[bytes, int] = {}
            symbols = [numbers.setdefault(x, len(numbers)) for x in own[lo : hi + 1]]
            found += [(lo + s, n, q) for s, n, q in runs_of(symbols, least, exponent)]
        if found:
            kept = np.ones(len(own), bool)
            for s, n, q in found:
                kept[s + q : s + n] = False
            own = [own[j] for j in np.flatnonzero(kept).tolist()]
        yield found, b" ".join(own)


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, exponent: int = EXPONENT) -> DataFrame:
    """id_col, runs (array of start, length, period, all long, by start and period) and collapsed of each row.

    Words lie between spaces and the control characters from tab to carriage return.
    A run is a stretch of words of smallest period q, at least `least` words and
    `exponent` (3 or more) times q long, that no neighbouring word extends. collapsed
    is the words joined by one space, without those that any run holds after its first q.
    Null and empty texts have no runs and collapse to an empty text. Ids may be null or
    repeated: each row has its own result. Other columns are left out, whatever their
    names. Texts may be of any length; one text's automata are held at a time.
    """
    if exponent < 3:
        raise ValueError(f"exponent must be 3 or more, not {exponent}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch["text"].to_pylist()
            for part in spans.chunks(texts):
                runs, collapsed = zip(*text_runs(texts[part], least, exponent))
                flat = np.array([r for own in runs for r in own], np.int64).reshape(-1, 3)
                ends = np.r_[0, np.cumsum([len(own) for own in runs])].astype(np.int32)
                structs = pa.StructArray.from_arrays([pa.array(flat[:, j].copy()) for j in range(3)], ["start", "length", "period"])
                ids = batch["id"].slice(part.start, part.stop - part.start)
                yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(pa.array(ends), structs), pa.array(collapsed, pa.binary()).cast(pa.string())], ["id", "runs", "collapsed"])

    rows = docs.select(quoted(id_col).alias("id"), quoted(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    found = rows.mapInArrow(run, f"id {kind}, runs array<struct<start: long, length: long, period: long>>, collapsed string")
    return found.select(F.col("id").alias(id_col), "runs", "collapsed")
