"""Connected components of an edge table, by alternating large-star and small-star."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.sources.shared import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    joined = down.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return joined.unionByName(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def _state(edges: DataFrame) -> tuple:
    """Count and hash sums; equal states mean equal edge sets."""
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count("*"), F.sum(h % 1000003), F.bit_xor(h)).first())


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Label every node of an undirected edge table by its component's least node.

    edges: columns u, v of one ordered type; self loops, nulls and repeats are
    allowed and carry no information. Returns node, root for every node that has
    an edge to another node. An empty table gives an empty result. Edges stay in
    tables; only a count and two hash sums reach the driver in each round.
    """
    edges = edges.select("u", "v").where("u is not null and v is not null and u != v")
    edges = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = _state(edges)
    if before[0]:
        for _ in range(max_rounds):
            edges = materialize(_small_star(_large_star(edges)), "edges")
            after = _state(edges)
            if after == before:
                break
            before = after
        else:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def settle(parent: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Unite the ends of links in a least-label forest of flat trees."""
    while True:
        a, b = parent[u], parent[v]
        open_ = a != b
        if not open_.any():
            return parent
        u, v, a, b = u[open_], v[open_], a[open_], b[open_]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up
