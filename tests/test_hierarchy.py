import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from arborlake.operators.hierarchy import descendants, hierarchy, newest_links

LINK = "child_id string, parent_id string, loaded_at timestamp, node string, parent string, _n int"


def rows(pairs):
    return [(c, p, datetime(2024, 1, 1), "x", "y", 1) for c, p in pairs]


def brute(parent):
    out = {}
    for n in parent:
        seen, x = {}, n
        while parent.get(x) and x not in seen:
            seen[x] = len(seen)
            x = parent[x]
        if x in seen:
            out[n] = (min(y for y in seen if seen[y] >= seen[x]), -1)
        else:
            out[n] = (x, len(seen))
    return out


@pytest.mark.parametrize("seed,peels", [(1, 8), (2, 1), (3, None), (4, 0)])
def test_random_forests_with_circles(spark, seed, peels):
    rng = random.Random(seed)
    ids = [f"n{i}" for i in range(120)]
    parent = {n: rng.choice([*ids[max(0, i - 4) : i], None, "outside"]) if i > 20 else rng.choice(ids[:21]) for i, n in enumerate(ids)}
    for i in range(107, 119):  # a long chain
        parent[ids[i]] = ids[i + 1]
    parent[ids[119]] = None
    links = newest_links(spark.createDataFrame(rows(parent.items()), LINK))
    tree = hierarchy(links, max_peels=peels, least_peeled=0)
    got = {r.node: (r.root, r.depth) for r in tree.filter("not implicit").collect()}
    assert got == brute(parent)
    for r in tree.filter("path is not null").collect():
        assert r.path[0] == r.root and r.path[-1] == r.node and len(r.path) == r.depth + 1
    below = {(r.ancestor, r.node) for r in descendants(tree).collect()}
    assert len(below) == sum(d for _, d in got.values() if d > 0)
    sizes = {r.node: r.subtree_size for r in tree.collect()}
    for n in got:
        if got[n][1] >= 0:
            assert sizes[n] == 1 + sum(a == n for a, _ in below)


def test_newest_row_nulls_empty_parents_and_copies(spark):
    t = [("a", "old", datetime(2024, 1, 1)), ("a", "new", datetime(2024, 1, 2)), ("a", "new", datetime(2024, 1, 2)), (None, "x", datetime(2024, 1, 1)), ("b", "", datetime(2024, 1, 1)), ("c", None, None), ("d", "d", None)]
    got = {r.node: r.parent for r in newest_links(spark.createDataFrame(t, "child_id string, parent_id string, loaded_at timestamp")).collect()}
    assert got == {"a": "new", "b": None, "c": None, "d": "d"}
    tree = {r.node: (r.root, r.depth, r.on_cycle) for r in hierarchy(spark.createDataFrame(list(got.items()), "node string, parent string")).collect()}
    assert tree["d"] == ("d", -1, True) and tree["a"] == ("new", 1, False) and tree["b"] == ("b", 0, False)


def test_empty_table(spark):
    assert hierarchy(spark.createDataFrame([], "node string, parent string")).count() == 0


def test_hot_parent_is_salted(spark, monkeypatch):
    import arborlake.operators.hierarchy as h
    import arborlake.runtime as r

    monkeypatch.setattr(h, "hot_keys", lambda counts, key, n, total: r.hot_keys(counts, key, n, total, least=10))
    pairs = [(f"c{i}", "hub") for i in range(300)] + [("hub", "top"), ("x", "c1")]
    tree = hierarchy(spark.createDataFrame(pairs, "node string, parent string"))
    depth = {r.node: r.depth for r in tree.collect()}
    assert depth["top"] == 0 and depth["hub"] == 1 and depth["x"] == 3 and all(depth[f"c{i}"] == 2 for i in range(300))
    assert tree.filter(F.col("node") == "hub").first().subtree_size == 302


@pytest.mark.parametrize("peels", [0, 1, 8])
def test_nodes_below_circles_have_descendants_and_the_core_sizes(spark, peels):
    parent = {"a": "b", "b": "c", "c": "a", "self": "self", "s1": "self", "r": None} | {f"d{i}": f"d{i - 1}" if i else "b" for i in range(5)} | {"e": "d1"} | {f"t{i}": f"t{i - 1}" if i else "r" for i in range(12)}
    up = {}
    for n in parent:
        up[n], x = [], parent[n]
        while x and x not in ("a", "b", "c", "self"):
            up[n].append(x)
            x = parent[x]
    want = {(a, n, k + 1) for n in parent if n not in ("a", "b", "c", "self") for k, a in enumerate(up[n])}
    tree = hierarchy(spark.createDataFrame(list(parent.items()), "node string, parent string"), max_peels=peels, least_peeled=0)
    assert {tuple(r) for r in descendants(tree, below_circles=True).collect()} == want
    sizes = {n: None if n in ("a", "b", "c", "self") else 1 + sum(a == n for a, _, _ in want) for n in parent}
    assert {r.node: r.subtree_size for r in tree.collect()} == sizes


def test_long_circles_and_chains_cost_rows_of_constant_size(spark):
    n = 100_000
    ids = spark.range(n).select(F.format_string("c%06d", "id").alias("node"), F.format_string("c%06d", (F.col("id") + 1) % n).alias("parent"))
    chain = spark.range(n).select(F.format_string("d%06d", "id").alias("node"), F.when(F.col("id") > 0, F.format_string("d%06d", F.col("id") - 1)).alias("parent"))
    tail = spark.range(30).select(F.format_string("t%02d", "id").alias("node"), F.when(F.col("id") == 0, "c000500").otherwise(F.format_string("t%02d", F.col("id") - 1)).alias("parent"))
    tree = hierarchy(ids.unionByName(chain).unionByName(tail), with_paths=False)
    got = tree.groupBy(F.substring("node", 1, 1).alias("k"), "root", "on_cycle").agg(F.count("*").alias("n"), F.min("depth").alias("low"), F.max("depth").alias("high"), F.sum("subtree_size").alias("s")).collect()
    assert {tuple(r) for r in got} == {("c", "c000000", True, n, -1, -1, None), ("d", "d000000", False, n, 0, n - 1, n * (n + 1) // 2), ("t", "c000000", False, 30, -1, -1, 465)}
