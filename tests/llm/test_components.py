import random

import pytest

from arborlake.llm.components import connected_groups, linked_pairs


def brute(pairs):
    p = {}

    def find(x):
        while p.setdefault(x, x) != x:
            x = p[x]
        return x

    for a, b in pairs:
        ra, rb = find(a), find(b)
        if ra != rb:
            p[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in p}


def pairs_of(spark, pairs):
    return spark.createDataFrame([(min(a, b), max(a, b)) for a, b in set(pairs)], "u string, v string").distinct()


@pytest.mark.parametrize("seed", [1, 2])
def test_random_graphs(spark, seed):
    rng = random.Random(seed)
    pairs = {tuple(sorted((f"n{rng.randrange(150):03d}", f"n{rng.randrange(150):03d}"))) for _ in range(90)}
    pairs = {(a, b) for a, b in pairs if a != b}
    pairs |= {("n000", f"leaf{i:03d}") for i in range(60)} | {(f"p{i:03d}", f"p{i + 1:03d}") for i in range(64)}
    got = {r.node: r.group_id for r in connected_groups(pairs_of(spark, pairs)).collect()}
    assert got == brute(pairs)


def test_hub_is_salted(spark, monkeypatch):
    import arborlake.llm.components as c
    import arborlake.runtime as r

    monkeypatch.setattr(c, "hot_keys", lambda counts, key, n, total: r.hot_keys(counts, key, n, total, least=8))
    pairs = {("hub", f"x{i:03d}") for i in range(100)} | {(f"x{i:03d}", f"y{i:03d}") for i in range(0, 100, 3)} | {("a", "b")}
    got = {r.node: r.group_id for r in connected_groups(pairs_of(spark, pairs)).collect()}
    assert got == brute(pairs)


def test_what_counts_as_a_link(spark):
    nan = float("nan")
    rows = [("a", "b", 0.55), ("b", "a", 0.1), ("c", "c", 0.9), ("d", "e", nan), ("d", "e", None), ("f", "g", -1.0), (None, "h", 0.9), ("i", "j", 0.54), ("k", "l", 0.7), ("l", "k", 0.7), ("k", "l", 0.7)]
    df = spark.createDataFrame([(*r, "u", 1) for r in rows], "id_a string, id_b string, rerank_score double, u string, w int")
    assert sorted(tuple(r) for r in linked_pairs(df, 0.55).collect()) == [("a", "b"), ("k", "l")]


def test_empty(spark):
    assert connected_groups(spark.createDataFrame([], "u string, v string")).count() == 0
