"""Toxicity scores: gradient-boosted trees over dense features, isotonically calibrated.

A bounded sample of labelled rows fits the model: their words and word prefixes
give a lexicon by smoothed log odds (counted on the cluster), features come from
lexicon densities, second-person proximity, capitals, punctuation and
obfuscation rates, and a part of the sample that neither the lexicon nor the
trees saw calibrates the scores. Scoring is one pass over all documents without
a shuffle. Only the text is an input of a score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from pagelens.sources.shared import long_rows, materialize, quoted

SAMPLE_ROWS = 20_000  # labelled rows that fit the model, at most
LEXICON_SIZE = 5_000  # entries that the fitted lexicon keeps, at most
MIN_DOCS = 8  # labelled documents that hold an entry, at least
MIN_LOG_ODDS = 2.5
PREFIXES = (3, 4, 5, 6, 7, 8)
THRESHOLD = 0.3

# Words that address the reader, in the languages of the corpus.
SECOND_PERSON = frozenset("you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch euer tú ti tus usted ustedes vosotros".split())
# Characters that stand in for letters.
LOOKALIKES = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l"})

_WORD = re.compile(r"[^\W\d_]+")
_MASKED = re.compile(r"[^\W\d_]+(?:[0-9@$!|*]+[^\W\d_]+)+")
_SPACED = re.compile(r"\b(?:[^\W\d_][ .\-*_]){3,}[^\W\d_]\b")
_RUN = re.compile(r"([^\W\d_])\1{2,}")

_PLANE = [chr(c) for c in range(0x10000)]  # the last stands for all beyond, which count as no letters
_UPPER = np.array([c.isupper() for c in _PLANE])
_LETTER = np.array([c.isalpha() for c in _PLANE])
_MARK = np.array([c < "\x80" and not c.isalnum() and not c.isspace() for c in _PLANE])
N_FEATURES = 16


def terms(text: str | None) -> set[str]:
    """Whole words and word prefixes (marked by a closing hyphen) of a text."""
    words = set(_WORD.findall((text or "").lower()))
    return words | {w[:n] + "-" for w in words for n in PREFIXES if len(w) > n}


def _weight(word: str, lexicon: dict[str, float]) -> float:
    return max([lexicon.get(word, 0.0), *(lexicon.get(word[:n] + "-", 0.0) for n in PREFIXES if len(word) > n)])


class _Weights(dict):
    """Weights of words seen so far; forgets all when full, so memory stays bounded."""

    def __init__(self, lexicon: dict[str, float]):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, word: str) -> float:
        if len(self) > 300_000:
            self.clear()
        w = self[word] = _weight(word, self.lexicon)
        return w


def features(text: str | None, weights: _Weights) -> list[float]:
    """The dense features of one whole text; all zero for a null or empty one."""
    if not text:
        return [0.0] * N_FEATURES
    low = text.lower()
    words = _WORD.findall(low)
    n = max(1, len(words))
    w = np.fromiter(map(weights.__getitem__, words), np.float64, len(words))
    hits = np.flatnonzero(w)
    second = np.flatnonzero(np.fromiter((x in SECOND_PERSON for x in words), bool, len(words)))
    close = 0
    if len(hits) and len(second):
        at = np.searchsorted(second, hits)
        left = hits - second[np.maximum(at - 1, 0)]
        right = second[np.minimum(at, len(second) - 1)] - hits
        close = int(((np.abs(left) <= 5) | (np.abs(right) <= 5)).sum())
    codes = np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 0xFFFF)
    letters, upper, marks = int(_LETTER[codes].sum()), int(_UPPER[codes].sum()), int(_MARK[codes].sum())
    masked = _MASKED.findall(low) if marks or any(map(str.isdigit, low)) else []
    unmasked = [weights[x] for m in masked for x in _WORD.findall(m.translate(LOOKALIKES).replace("*", ""))]
    spaced = _SPACED.findall(low)
    size = len(text)
    return [
        100.0 * float(w.sum()) / n,
        100.0 * len(hits) / n,
        float(w.max()) if len(w) else 0.0,
        float(np.log1p(len(hits))),
        float(np.log1p(len({words[i] for i in hits}))),
        100.0 * len(second) / n,
        100.0 * close / n,
        upper / max(1, letters),
        sum(map(str.isupper, text.split())) / n if upper > 0.2 * letters else 0.0,
        100.0 * (text.count("!") + text.count("?")) / size,
        100.0 * marks / size,
        100.0 * len(masked) / n,
        100.0 * sum(x > 0 for x in unmasked) / n,
        100.0 * len(_RUN.findall(low)) / n,
        float(np.log1p(len(words))),
        100.0 * len(spaced) / n,
    ]


def _features_udf(lexicon: dict[str, float]):
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weights = _Weights(lexicon)
        for s in texts:
            yield pd.Series([features(x, weights) for x in s], dtype=object)

    run.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, ArrayType(DoubleType()))


def _term_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of a partition's documents, toxic and other, by term."""
    toxic: Counter = Counter()
    other: Counter = Counter()
    for pdf in batches:
        for text, label in zip(pdf["text"], pdf["label"]):
            (toxic if label else other).update(terms(text))
        if len(toxic) + len(other) > 500_000:
            yield _as_rows(toxic, other)
            toxic, other = Counter(), Counter()
    yield _as_rows(toxic, other)


def _as_rows(toxic: Counter, other: Counter) -> pd.DataFrame:
    names = list(toxic.keys() | other.keys())
    return pd.DataFrame({"term": pd.Series(names, dtype=str), "toxic": [toxic[t] for t in names], "other": [other[t] for t in names]}).astype({"toxic": "int64", "other": "int64"})


def fit_lexicon(sample: DataFrame, size: int = LEXICON_SIZE) -> dict[str, float]:
    """Log odds of the terms that mark label 1 in sample (text, label)."""
    n = {bool(r["label"]): r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    counts = sample.select("text", "label").mapInPandas(_term_counts, "term string, toxic long, other long")
    odds = F.log((F.col("toxic") + 0.5) / (n.get(True, 0) + 1.0)) - F.log((F.col("other") + 0.5) / (n.get(False, 0) + 1.0))
    best = (
        counts.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
        .withColumn("odds", odds)
        .where((F.col("toxic") >= MIN_DOCS) & (F.col("odds") >= MIN_LOG_ODDS))
        .orderBy(F.desc(F.col("odds") * F.log1p("toxic")), "term")
        .limit(size)
    )
    return {r["term"]: float(r["odds"]) for r in best.collect()}


@dataclass
class ToxicityModel:
    """A fitted model; base is the share of label 1, the score where nothing could be learned."""

    lexicon: dict[str, float]
    base: float
    trees: GBTClassificationModel | None = None
    calibration: IsotonicRegressionModel | None = None


def labelled_sample(labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """At most `rows` labelled ids (doc_id, label), those with the smallest hashes; a repeated id is toxic if any of its rows is."""
    by_id = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("label"))
    return by_id.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, trees: int = 20, depth: int = 4) -> ToxicityModel:
    """Fit on docs (doc_id, text) and labels (doc_id, toxic). All given labels may be used; leave held-out rows out."""
    picked = labelled_sample(labels, rows)
    sample = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")  # picked has `rows` rows at most
    part = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("part")), F.lit(4))
    sample = materialize(sample.select("text", "label", (part == 0).alias("calibrate")), "toxic-sample")
    rate = sample.agg(F.avg("label")).first()[0]
    fitting = sample.where("not calibrate")
    kinds = {r["label"] for r in fitting.select("label").distinct().collect()}
    if len(kinds) < 2:
        return ToxicityModel({}, float(rate or 0.0))
    lexicon = fit_lexicon(fitting)
    dense = sample.select("label", "calibrate", _features_udf(lexicon)("text").alias("x"))
    dense = materialize(dense, "toxic-features").select(F.col("label").cast("double").alias("label"), "calibrate", array_to_vector("x").alias("features"))
    gbt = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.3, seed=7, cacheNodeIds=False, minInstancesPerNode=5)
    model = gbt.fit(dense.where("not calibrate").coalesce(4))
    held = model.transform(dense.where("calibrate")).select("label", vector_to_array("probability")[1].alias("p"))
    calibration = None
    if held.select("label").distinct().count() == 2:
        calibration = IsotonicRegression(labelCol="label", featuresCol="p", predictionCol="calibrated").fit(held)
    return ToxicityModel(lexicon, float(rate), model, calibration)


def score(docs: DataFrame, model: ToxicityModel, text_col: str = "text", prefix: str = "tox_") -> DataFrame:
    """docs with <prefix>score (0 to 1) added; every row stays.

    Null and empty texts are scored as texts without a word. Repeated rows get
    equal scores. An empty table gives an empty result. The added column
    replaces one of its name.
    """
    long_rows(docs.sparkSession)
    name = f"{prefix}score"
    docs = docs.drop(name)
    if model.trees is None:
        return docs.withColumn(name, F.lit(model.base))
    own = docs.select(F.struct(*map(quoted, docs.columns)).alias("__row"), array_to_vector(_features_udf(model.lexicon)(F.col(text_col))).alias("features"))
    out = model.trees.transform(own).select("__row", vector_to_array("probability")[1].alias("p"))
    if model.calibration is None:
        value = F.col("p")
    else:  # a small share of the raw probability orders the rows of one step of the calibration
        out = model.calibration.transform(out)
        value = 0.995 * F.least(F.greatest(F.col("calibrated"), F.lit(0.0)), F.lit(1.0)) + 0.005 * F.col("p")
    return out.select("__row", value.alias(name)).select("__row.*", name)


def held_out(id_col: str = "doc_id"):
    """Whether a row is kept for measurement; null ids are not."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))
