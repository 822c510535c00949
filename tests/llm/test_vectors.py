import numpy as np
from pyspark.sql import functions as F

from pagelens.llm import cover_search, rabitq, vectors


def data(n=600, dim=16, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((8, dim)) * 2
    return np.arange(n), (centres[rng.integers(0, 8, n)] + rng.standard_normal((n, dim))).astype(np.float32)


ODD = [(9001, None), (9002, [None] * 16), (9003, [float("nan")] * 16), (9004, [float("inf")] * 16), (9006, []), (None, [1.0] * 16), (9050, [1.0, 2.0, 3.0]), (9051, [2.0, 1.0, 0.5])]


def table(spark, ids, m, extra=ODD):
    return spark.createDataFrame([(int(i), [float(x) for x in v], 1) for i, v in zip(ids, m)] + [(a, b, 2) for a, b in extra], "vec_id long, embedding array<float>, id long")


def test_exact_search(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 200)
    monkeypatch.setattr(cover_search, "LEAF", 8)
    ids, m = data()
    m[10:14] = m[5]  # ties
    got = cover_search.top_k(table(spark, ids, m), F.col("id") % 50 == 0, 5).collect()
    w = np.floor(m.astype(float) * 256)
    for q in ids[ids % 50 == 0]:
        s = w @ w[q]
        s[q] = -np.inf
        order = np.lexsort((ids, -s))[:5]
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [(r.vec_id, r.score) for r in mine] == [(int(i), int(s[i])) for i in order]
    assert {(r.query_id, r.vec_id) for r in got if r.query_id > 9000} == {(9050, 9051)}


def test_trees_cover_their_points():
    ids, m = data(300)
    tree = cover_search.CoverTree(ids, np.floor(m * 256).astype(np.int64))
    for i, (lo, hi) in enumerate(tree.span):
        assert np.sqrt(((tree.points[lo:hi] - tree.centre[i]) ** 2).sum(axis=1)).max() <= tree.radius[i] + 1e-9
    assert sorted(tree.ids) == list(ids)


def test_nearest_neighbours_recall(spark):
    ids, m = data(1200, 32)
    got = rabitq.nearest(table(spark, ids, m, [(7777, [0.0] * 32)]), F.col("id") % 20 == 0, 10).collect()
    d = m.astype(float)
    hit = 0
    for q in ids[ids % 20 == 0]:
        s = d @ d[q]
        s[q] = -np.inf
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, 11))
        assert np.allclose([r.score for r in mine], s[[r.vec_id for r in mine]], rtol=1e-12)
        hit += len({r.vec_id for r in mine} & set(np.argsort(-s)[:10].tolist()))
    assert hit >= 0.9 * 10 * (ids % 20 == 0).sum()
    assert all(7777 not in (r.vec_id, r.query_id) for r in got)


def test_equal_vectors_tie_to_the_smaller_id(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 70)
    ids, m = data(400, 33, 3)
    for at in (20, 40, 60):
        m[[at + 101, at + 203, at + 305]] = m[at + 7]
    got = rabitq.nearest(table(spark, ids, m, []), F.col("id") % 20 == 0, 20).collect()
    by = {}
    for r in got:
        by.setdefault((r.query_id, r.score), []).append((r.rank, r.vec_id))
    assert all([v for _, v in sorted(x)] == sorted(v for _, v in x) for x in by.values())
    same = [{at + 7, at + 101, at + 203, at + 305} for at in (20, 40, 60)]
    assert any(len({v for _, v in x} & s) >= 3 for x in by.values() for s in same)


def test_packed_estimates_stay_within_their_bounds():
    ids, m = data(500, 48, 5)
    m = m.astype(float)
    turn, centre = rabitq.rotation(48), m.mean(axis=0)
    block = rabitq._load(rabitq.encode(ids, m, centre, turn))
    value, error = rabitq.estimate(block, {"vectors": m[:40], **rabitq.planes(m[:40], turn)}, centre, rabitq.EPSILON)
    assert (np.abs(value - m[:40] @ m.T) <= error).mean() > 0.97


def test_pruning_fires():
    ids, m = data(3000, 16, 7)
    w = np.floor(m * 256).astype(np.int64)
    data_tree, query_tree = cover_search.CoverTree(ids, w), cover_search.CoverTree(ids[::50], w[::50])
    assert len(data_tree.span) > 1 and len(query_tree.span) >= 1 and data_tree.radius.max() > 0


def test_fewer_candidates_and_empty_tables(spark):
    few = table(spark, np.array([0, 1, 2]), np.eye(3, 16), [])
    assert cover_search.top_k(few, F.col("id") % 50 == 0, 5).count() == 2
    assert rabitq.nearest(few, F.col("id") % 20 == 0, 20).count() == 2
    none = few.where("false")
    assert cover_search.top_k(none, F.col("id") % 50 == 0).count() == 0
    assert rabitq.nearest(none, F.col("id") % 20 == 0).count() == 0


def test_leaves_are_scored_together(monkeypatch):
    """Vectors about equally far from each other give trees of tiny leaves; each query leaf still scores the block in few products."""
    rng = np.random.default_rng(2)
    w = np.floor(rng.standard_normal((4000, 64)) * 256).astype(np.int64)
    d, q = cover_search.CoverTree(np.arange(4000), w), cover_search.CoverTree(np.arange(0, 4000, 20), w[::20])
    calls, plain = [0], np.lexsort
    monkeypatch.setattr(np, "lexsort", lambda *x, **y: (calls.__setitem__(0, calls[0] + 1), plain(*x, **y))[1])
    ids, found, score = cover_search.dual_tree(q, d, np.full(200, -np.inf), 5)
    assert calls[0] <= 200 * 3 and len(ids) == 1000
    s = (w[::20] @ w.T).astype(float)
    s[np.arange(200), np.arange(0, 4000, 20)] = -np.inf
    assert np.array_equal(np.sort(score.reshape(-1, 5), axis=1), np.sort(np.array([np.sort(s[i // 20])[-5:] for i in ids[::5]]), axis=1))
