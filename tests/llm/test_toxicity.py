import random

from pyspark.sql import functions as F

from pagelens.llm import toxicity as t
from tests.llm.common import TEXTS, documents, empty

WORDS = [f"w{i}o" for i in "abcdefghijklmnopqrst"]


def corpus(n=600):
    random.seed(4)
    rows, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        words = random.choices(WORDS, k=60)
        if bad:
            for k in random.sample(range(60), 4):
                words[k] = random.choice(["vilething", "nastyone"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    return rows, labels


def test_learns_what_labels_mark(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame(labels + [(None, 1), (3, None), (0, 1)], "doc_id long, toxic int")
    model = t.fit(docs, known.where(~t.held_out()), trees=4)
    got = {r.doc_id: r.tox_score for r in t.score(docs.where(t.held_out()), model).collect()}
    assert got and all(0 <= s <= 1 for s in got.values())
    assert all((s >= t.THRESHOLD) == (i % 4 == 0) for i, s in got.items())
    odd = t.score(documents(spark), model)
    assert odd.count() == len(TEXTS) and odd.where("tox_score is null").count() == 0
    assert t.score(empty(spark), model).count() == 0


def test_without_labels_the_score_is_the_base_rate(spark):
    model = t.fit(documents(spark), spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.tox_score for r in t.score(documents(spark), model).collect()} == {0.0}


def test_held_out(spark):
    import zlib

    got = spark.range(50).select("id", t.held_out("id").alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in got)
    assert spark.sql("select cast(null as long) id").select(t.held_out("id").alias("h")).first().h is False


def test_features_of_whole_texts():
    weights = t._Weights({"vile-": 2.0, "nasty": 3.0})
    x = t.features("You VILELY n4sty nasty " + "w " * 50_000, weights)
    assert len(x) == t.N_FEATURES and x[3] > 0 and x[6] > 0
    assert t.features(None, weights) == t.features("", weights) == [0.0] * t.N_FEATURES
    assert F is not None


def test_capitals_of_all_scripts_and_a_column_of_the_same_name(spark):
    weights = t._Weights({})
    assert t.features("ВСЕ ЗАГЛАВНЫЕ ΟΛΑ", weights)[7] == 1.0
    assert t.features("😀😀 a", weights)[7] == 0.0
    docs = spark.createDataFrame([(1, "x", 9.0, 2)], "doc_id long, text string, tox_score double, `a.b` int")
    scored = t.score(docs, t.ToxicityModel({}, 0.25))
    assert scored.columns.count("tox_score") == 1 and scored.first().tox_score == 0.25


def test_held_out_ranking_on_the_test_tables(spark):
    """AUC of held-out labels, of a model that has seen the other three quarters."""
    sf = "/root/testdata/sf0.01"
    labels, docs = spark.read.parquet(f"{sf}/labels.parquet"), spark.read.parquet(f"{sf}/documents.parquet")
    model = t.fit(docs, labels.where(~t.held_out()), trees=20)
    held = labels.where(t.held_out()).where("toxic is not null").select("doc_id", "toxic")
    rows = t.score(docs.select("doc_id", "text"), model).join(held, "doc_id").select("tox_score", "toxic").collect()
    good, bad = [r.tox_score for r in rows if not r.toxic], [r.tox_score for r in rows if r.toxic]
    auc = sum((b > g) + 0.5 * (b == g) for b in bad for g in good) / (len(bad) * len(good))
    assert auc >= 0.8  # few of these documents have a label; the README has the figures of sf0.1
