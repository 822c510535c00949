import math
import random
import re

from pagelens.llm import lexical_search as s
from tests.llm.common import TEXTS, documents, empty

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k=10):
    own = [(i, terms(t)) for i, t in docs]
    n_docs, n_tokens = sum(bool(t) for _, t in own), sum(len(t) for _, t in own)
    wanted = {}
    for i, t in items:
        if i is not None:
            wanted.setdefault(i, set()).update(terms(t))
    df = {x: sum(x in t for _, t in own) for x in set().union(*wanted.values())}
    out = []
    for item, names in wanted.items():
        scored = []
        for i, t in own:
            m = 100 - 90 + 90 * len(t) * n_docs // max(n_tokens, 1)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * (1000000000 * t.count(x) // (1000 * t.count(x) + 8 * m)) for x in names)
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, r + 1, None if x[1] else x[2], -x[0]) for r, x in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_equals_brute_force(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(80)] + ["Été", "日本", "x1", "A-b", " ", "Ｗ"]
    docs = [(i, " ".join(rng.choices(words, weights=range(1, len(words) + 1), k=rng.randrange(60)))) for i in range(300)]
    docs += [(i + 1000, t) for i, t in docs[:40]]  # ties
    items = [(i, " ".join(rng.choices(words, k=rng.randrange(9)))) for i in range(30)] + [(3, "w1 w2"), (None, "w5"), (99, None)]
    table, asked = documents(spark, docs), spark.createDataFrame(items, "item_id int, text string")
    want = brute(docs, items)
    assert rows(s.search(table, asked)) == want
    assert rows(s.search(table.repartition(7), asked, item_terms_at_once=20)) == want  # several slices


def test_awkward_rows(spark):
    items = [(1, "The cat"), (2, "text"), (3, "日本語 é"), (4, ""), (5, "  "), (6, "lorem amet"), (1, "door")]
    asked = spark.createDataFrame([(*r, "a", 1) for r in items], "item_id long, text string, doc_id string, score int")
    assert rows(s.search(documents(spark), asked)) == brute([(i, t) for i, t in TEXTS], items)
    assert s.search(empty(spark), asked).count() == 0
    assert s.search(documents(spark), asked.limit(0)).count() == 0
