import random

from pagelens.llm.graph import connected_components


def test_components_of_chains_stars_and_noise(spark):
    random.seed(5)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(random.randrange(200, 300), random.randrange(200, 300)) for _ in range(60)] + [(7, 7), (None, 3), (5, 4), (5, 4)]
    parent = {n: n for e in edges for n in e if n is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {n: root(n) for n in parent if any(n in e and e[0] != e[1] and None not in e for e in edges)}


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0
