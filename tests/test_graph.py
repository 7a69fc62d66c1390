"""Connected components against union-find, by one chunk and by rounds."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from sorbus.operators import graph
from sorbus.operators.graph import connected_components, forest
from sorbus.plans.packed import few_at_once


def by_union_find(pairs):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    for a, b in pairs:
        if a is not None and b is not None:
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    return {x: root(x) for x in list(up)}


def random_graph(seed):
    rng = np.random.default_rng(seed)
    pairs = rng.integers(0, 400, (260, 2)).tolist()
    chain = rng.permutation(np.arange(1000, 1200)).tolist()
    star = [[5000, x] for x in range(5001, 5200)] + [[x, 7000] for x in range(6000, 6150)]  # hubs below and above their leaves
    return [tuple(p) for p in [*pairs, *map(list, zip(chain, chain[1:])), *star, [9, 9], [9000, 9000], [None, 3], [4, None], *pairs[:20], *[p[::-1] for p in pairs[:20]]]]


@pytest.mark.parametrize("rounds", [False, True])
def test_components(spark, monkeypatch, rounds):
    if rounds:
        monkeypatch.setattr(graph, "CHUNK", 25)
        monkeypatch.setattr(graph, "HOT", 30)
    for seed, kind in ((1, "long"), (2, "string")):
        pairs = random_graph(seed)
        name = (lambda x: x) if kind == "long" else (lambda x: None if x is None else f"n{x:06d}")
        pairs = [(name(a), name(b)) for a, b in pairs]
        df = spark.createDataFrame(pairs, f"src {kind}, dst {kind}").repartition(3)
        got = connected_components(df).collect()
        assert {r.node: r.component for r in got} == by_union_find(pairs) and len(got) == len({r.node for r in got})
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_forests_keep_what_is_connected(spark):
    pairs = [p for p in random_graph(3) if None not in p and p[0] != p[1]]
    made = forest(spark.createDataFrame(pairs, "src long, dst long").coalesce(2), 50).collect()
    want = {x: r for x, r in by_union_find(pairs).items()}
    assert by_union_find([(r.src, r.dst) for r in made]) == want and all(r.src > r.dst for r in made)
    assert len(made) < len(pairs)


def test_a_star_spreads(spark, monkeypatch):
    """A hub of most edges: before its lookups, they stay in their partitions."""
    monkeypatch.setattr(graph, "CHUNK", 1000)
    leaves = spark.range(1, 40_001, 1, 8).select(F.col("id").alias("src"), F.lit(0).cast("long").alias("dst"))
    chain = spark.range(50_000, 52_000, 1, 2).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    e = graph.shared(forest(leaves.union(chain)))
    out = graph.hung_lower(e, 500)
    busy = out.where("dst = 0").groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(busy) == 8 and max(r["count"] for r in busy) <= 2 * min(r["count"] for r in busy)
    got = connected_components(leaves.union(chain), hot=500).groupBy("component").count().collect()
    assert {r.component: r["count"] for r in got} == {0: 40_001, 50_000: 2001}


def test_what_makes_a_forest_together_is_bounded(spark, monkeypatch):
    """A partition of many edges becomes several forests, each of FOREST edges; one of them all is made only at the end."""
    pairs = [p for p in random_graph(3) if None not in p and p[0] != p[1]]
    edges = spark.createDataFrame(pairs, "src long, dst long").coalesce(1)
    one = forest(edges).count()
    monkeypatch.setattr(graph, "FOREST", 50)
    with few_at_once(spark):  # FOREST is looked at between batches
        made = forest(edges).collect()
        assert len(made) > one == forest(edges, graph.CHUNK).count()
    assert by_union_find([(r.src, r.dst) for r in made]) == by_union_find(pairs)
    assert {r.node: r.component for r in connected_components(edges).collect()} == by_union_find(pairs)
