import re

import numpy as np
import xxhash

from pagelens.llm import simhash_dedup as s
from tests.llm.common import TEXTS, documents, empty


def brute_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) > 4 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0


def brute_components(prints, radius):
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= radius:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [root(i) for i in range(len(prints))]


def test_fingerprints():
    for _, text in TEXTS:
        assert s.fingerprint(text) & (2**64 - 1) == brute_fingerprint(text)
    assert s.fingerprint("A b c d") == s.fingerprint("a b c d") != s.fingerprint("Á b c d")


def test_tiles_find_every_link():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    near = base[rng.integers(0, 60, 240)] ^ (np.uint64(1) << rng.integers(0, 64, 240, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 240, dtype=np.uint64))
    values = np.unique(np.concatenate([base, near]))
    want = brute_components([int(x) for x in values], 4)
    a, b = values[::2], values[1::2]
    edges = [s.tile_links(a, None, 4), s.tile_links(b, None, 4), s.tile_links(a, b, 4)]
    at = {int(x): i for i, x in enumerate(values)}
    parent = np.arange(len(values))
    for u, v in edges:
        parent = s.settle(parent, np.array([at[int(x)] for x in u], int), np.array([at[int(x)] for x in v], int))
    groups = lambda labels: {frozenset(i for i, y in enumerate(labels) if y == x) for x in set(labels)}
    assert groups(parent.tolist()) == groups(want)


def test_components_with_nulls_and_repeats(spark):
    rows = s.simhash_components(documents(spark), tile=2).collect()
    assert len(rows) == len(TEXTS)
    ids, prints = [i for i, _ in TEXTS], [brute_fingerprint(t) for _, t in TEXTS]
    roots = brute_components(prints, 4)
    least = {p: min((j for j, r in zip(ids, roots) if r == root and j is not None), default=None) for p, root in zip(prints, roots)}
    for r in rows:
        assert r.component_id == least[r.fp & (2**64 - 1)]


def test_dedup_keeps_one_row_of_each_group(spark):
    kept = s.dedup(documents(spark)).collect()
    roots = brute_components([brute_fingerprint(t) for _, t in TEXTS], 4)
    assert len(kept) == len(set(roots))
    assert kept[0].row == "r" and set(kept[0].asDict()) == set(documents(spark).columns)


def test_empty_table(spark):
    assert s.simhash_components(empty(spark)).count() == 0
    assert s.dedup(empty(spark)).count() == 0
