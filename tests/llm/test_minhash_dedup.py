import random
import re
from unittest import mock

import numpy as np

from pagelens.llm import minhash_dedup as m
from tests.llm.common import TEXTS, documents, empty


def grams(text, width=2):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda x: x[0].lower(), text or ""))
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def brute(rows, width=2, percent=80):
    sets, label = [grams(t, width) for _, t in rows], list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if label[i] != label[j] and a and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                label = [label[j] if x == label[i] else x for x in label]
    least = {}
    for (i, _), x in zip(rows, label):
        least[x] = min([y for y in (i, least.get(x)) if y is not None], default=None)
    return sorted(((i, len(s), least[x], i == least[x]) for (i, _), s, x in zip(rows, sets, label)), key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def edited(rng, words, own, share):
    copy = list(own)
    for _ in range(rng.randrange(max(1, int(share * len(own))) + 1)):
        copy[rng.randrange(len(copy))] = rng.choice(words)
    return copy


def corpus(seed, bases, copies, size, share):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(bases):
        own = rng.choices(words, k=rng.randrange(1, size))
        texts += [own] + [edited(rng, words, own, share) for _ in range(rng.randrange(copies))]
    rng.shuffle(texts)
    return list(enumerate(" ".join(x) for x in texts))


def test_sketches_fill_every_bin_and_estimate():
    rng = np.random.default_rng(1)
    for n in (1, 2, 50, 5000):
        a = rng.integers(0, 2**64, n, np.uint64)
        assert (m.sketches([a], 504) != np.uint64(2**64 - 1)).all()
    for n, similarity in ((40, 0.5), (400, 0.8), (4000, 0.2)):
        estimates = []
        for _ in range(60):
            x = rng.integers(0, 2**64, n, np.uint64)
            both = round(2 * n * similarity / (1 + similarity) / 2)
            y = np.r_[x[:both], rng.integers(0, 2**64, n - both, np.uint64)]
            sketch = m.sketches([x, y], 504)
            estimates.append((sketch[0] == sketch[1]).mean() - both / (2 * n - both))
        assert abs(np.mean(estimates)) < 0.01 and np.std(estimates) < 0.03


def test_sketch_does_not_depend_on_company():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 2**64, int(n), np.uint64)) for n in rng.integers(1, 900, 40)]
    assert all((a == m.sketches([b], 504)[0]).all() for a, b in zip(m.sketches(sets, 504), sets))


def test_exact_pairs():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 30, int(n)).astype(np.uint64)) for n in rng.integers(1, 40, 120)]
    want = {(i, j) for j in range(120) for i in range(j) if 100 * len(set(sets[i]) & set(sets[j])) >= 80 * len(set(sets[i]) | set(sets[j]))}
    with mock.patch.object(m, "COLUMNS", 7):
        assert set(zip(*(x.tolist() for x in m.similar(sets, 80)))) == want
        assert set(zip(*(x.tolist() for x in m.similar(sets, 80, 50)))) == {(i, j) for i, j in want if i < 50 <= j}


def test_components_equal_brute_force(spark):
    rows = corpus(4, 60, 6, 120, 0.06)
    rows += [(i + 10_000, t.upper()) for i, t in rows[::7]]
    want = brute(rows)
    assert 10 < sum(not k for *_, k in want)
    assert got(m.components(documents(spark, rows))) == want
    assert got(m.components(documents(spark, rows), width=4, percent=60)) == brute(rows, 4, 60)


def test_groups_of_many_tiles(spark):
    rows = corpus(5, 3, 150, 100, 0.11)
    with mock.patch.object(m, "TILE", 12), mock.patch.object(m, "FLUSH", 50):
        assert got(m.components(documents(spark, rows).repartition(5))) == brute(rows)


def test_awkward_rows(spark):
    assert got(m.components(documents(spark))) == brute(TEXTS)
    rows = [(None, "a b c"), (None, "a b c"), (None, "d e"), (4, "D E"), (9, "x"), (8, "X"), (7, ""), (7, None), (6, "x y"), (5, "\x1c"), (5, "\x1c")]
    assert got(m.components(documents(spark, rows))) == brute(rows)
    assert m.components(empty(spark)).count() == 0
