import random

import pytest
from pyspark.sql import functions as F

from arborlake.operators import agreement as A
from arborlake.operators import graph as G
from arborlake.operators import lineage as L
from arborlake.operators import ordered as O
from arborlake.operators import similarity as S
from arborlake.operators import tree as R
from arborlake.operators.ranking import full_rank, sliding_pairs
from arborlake.operators.reshape import keep_last, upsert


def documents(seed):
    rng = random.Random(seed)
    return [(d, p, rng.randint(1, 4), f"t{d}.{p}", rng.random() < 0.3) for d in range(40) for p in range(rng.randint(0, 12))]


@pytest.mark.parametrize("seed", [1, 2])
def test_paths_and_shifts_against_a_stack(spark, seed):
    rows = documents(seed)
    df = spark.createDataFrame(rows, "doc int, pos int, level int, text string, generic boolean")
    path = {(r.doc, r.pos): r.path for r in O.heading_path(df, skip=F.col("generic")).collect()}
    moved = {(r.doc, r.pos): r.level for r in O.shift_levels(df, F.col("generic")).collect()}
    titles, generics, doc = {}, [], None
    for d, p, level, text, generic in rows:
        if d != doc:
            titles, generics, doc = {}, [], d
        titles = {k: v for k, v in titles.items() if k < level}
        assert path[d, p] == " > ".join(v for _, v in sorted(titles.items()) if v)
        titles[level] = "" if generic else text
        generics = [g for g in generics if g < level]
        if generic:
            generics.append(level)
            assert (d, p) not in moved
        else:
            assert moved[d, p] == max(1, level - len(generics))


def test_body_runs(spark):
    rows = [(1, 1, None, "lead"), (1, 2, 1, "H"), (1, 3, None, "a"), (1, 4, None, " "), (1, 5, None, "b"), (1, 6, 2, "K"), (2, 1, None, "x")]
    out = O.body_runs(spark.createDataFrame(rows, "doc int, pos int, level int, text string"), F.col("level").isNotNull()).collect()
    assert [(r.title, r.range, r.range_dense, r.content) for r in out] == [("H", "3-5", "3-4", "a\nb")]


def test_full_rank_and_sliding_pairs(spark):
    rng = random.Random(4)
    rows = [("hot" if rng.random() < 0.7 else rng.choice("ab"), i, rng.random()) for i in range(500)] + [(None, 1000, 0.5)]
    df = spark.createDataFrame(rows, "g string, id int, x double")
    got = {r.id: r.rank for r in full_rank(df, "g", [F.desc("x"), F.asc("id")]).collect()}
    for g in ("hot", "a", "b", None):
        order = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], r[1]))
        assert [got[r[1]] for r in order] == list(range(1, len(order) + 1))
    pairs = {(r.id_a, r.id_b) for r in sliding_pairs(df, ["g"], [F.col("id")], "id", 2).collect()}
    want = set()
    for g in ("hot", "a", "b"):
        ids = sorted(r[1] for r in rows if r[0] == g)
        want |= {(a, b) for i, a in enumerate(ids) for b in ids[i + 1 : i + 3]}
    assert pairs == want


def test_upsert_and_keep_last(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k int, v string")
    new = spark.createDataFrame([(2, "c", 1), (3, "d", 2), (3, "d", 2)], "k int, v string, extra int")
    assert sorted(((r.k or 0), r.v, r.extra) for r in upsert(old, new, ["k"]).collect()) == [(0, "n", None), (1, "a", None), (2, "c", 1), (3, "d", 2)]
    assert keep_last(old.limit(0), ["k"], F.col("v")).count() == 0


def test_components(spark):
    nodes = spark.createDataFrame([(i,) for i in range(40)], "id int")
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(30, 31), (31, 30)], "a int, b int")
    got = {r.id: r.component for r in G.components(nodes, edges).collect()}
    assert all(got[i] == 0 for i in range(21)) and got[31] == 30 and got[25] == 25
    assert {r.component for r in G.components(nodes, edges.limit(0)).collect()} == set(range(40))


def test_knn_keeps_equal_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, [0.0, 0.0])], "id int, v array<double>")
    got = {(r.id_a, r.rank_pos): r.id_b for r in S.exact_knn(v, v, 2).collect()}
    assert got[1, 0] == 2 and got[2, 0] == 1 and len(got) == 8


def test_trimmed_mean(spark):
    for n in (0, 1, 9, 10, 11, 25):
        xs = [float(x * x % 17) for x in range(n)]
        got = spark.range(1).select(G.trimmed_mean(F.array(*map(F.lit, xs)).cast("array<double>")).alias("m")).first().m
        k = n // 10
        core = sorted(xs)[k : n - k]
        assert got is None if not n else abs(got - sum(core) / len(core)) < 1e-9


def test_kappa_and_alpha_against_definitions(spark):
    rng = random.Random(3)
    rows = [(str(s), j, rng.choice([None, 1, 2, 3, 4, 5]), []) for s in range(80) for j in ("a", "b", "c")]
    df = spark.createDataFrame(rows, "sample_id string, judge_key string, q int, flags array<string>")
    ratings = {(s, j): q for s, j, q, _ in rows}
    for r in A.pairwise_kappa(df, "q", ["a", "b", "c"]).collect():
        both = [(ratings[str(s), r.judge_a], ratings[str(s), r.judge_b]) for s in range(80)]
        both = [(x, y) for x, y in both if x and y]
        n = len(both)
        seen = sum((x - y) ** 2 for x, y in both) / 16
        expected = sum((x - y) ** 2 for x, _ in both for _, y in both) / n / 16
        assert r.n == n and abs(r.weighted_kappa - (1 - seen / expected)) < 1e-9
    units = [[q for s, j, q, _ in rows if s == str(k) and q] for k in range(80)]
    units = [u for u in units if len(u) > 1]
    within = [(x - y) ** 2 for u in units for i, x in enumerate(u) for y in u[i + 1 :]]
    pooled = [x for u in units for x in u]
    every = [(x - y) ** 2 for i, x in enumerate(pooled) for y in pooled[i + 1 :]]
    alpha = A.interval_alpha(df, "q").first().alpha
    assert abs(alpha - (1 - (sum(within) / len(within)) / (sum(every) / len(every)))) < 1e-9
    const = spark.createDataFrame([("1", "a", 3, []), ("1", "b", 3, []), ("2", "a", 3, []), ("2", "b", 3, [])], df.schema)
    assert A.pairwise_kappa(const, "q", ["a", "b"]).first().weighted_kappa is None and A.interval_alpha(const, "q").first().alpha is None


def test_chase(spark):
    r = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "y"), ("y", "x"), ("z", "x"), ("s", "s"), (None, "q")], "src string, dst string")
    assert sorted(map(tuple, L.chase(r).collect())) == [("a", "d"), ("b", "d"), ("c", "d")]
    assert L.chase(r.limit(0)).count() == 0


def tree(spark):
    rows = [("ROOT", "", "ROOT", None, 0), ("a", "A", "L1", "ROOT", 0), ("b", "B", "L1", "ROOT", 1), ("c", "C", "L2", "a", 0), ("d", "D/x", "L3", "c", 0), ("e", "E", "L4", "d", 0), ("f", "F", "L4", "d", 1)]
    return spark.createDataFrame(rows, "node_id string, label string, level string, parent_id string, ord long")


def parents(df):
    return {r.node_id: r.parent_id for r in df.collect()}


def test_tree_edits(spark):
    t = tree(spark)
    moves = spark.createDataFrame([("d", "b"), ("a", "e"), ("c", "c"), ("f", "none")], "node_id string, new_parent_id string")
    assert parents(R.move_nodes(t, moves)) == parents(t) | {"d": "b"}
    assert set(parents(R.remove_subtrees(t, spark.createDataFrame([("c",)], "node_id string")))) == {"ROOT", "a", "b"}
    merged = parents(R.absorb(t, spark.createDataFrame([("c", "b")], "loser string, winner string")))
    assert merged == {"ROOT": None, "a": "ROOT", "b": "ROOT", "d": "b", "e": "d", "f": "d"}
    flat = parents(R.flatten_depth(t, max_depth=2, max_children=3))
    assert flat == {"ROOT": None, "a": "ROOT", "b": "ROOT", "e": "a", "f": "a"}
    table = {r.node_id: r for r in R.tree_table(t).collect()}
    assert table["e"].path_labels == ["", "A", "C", "D/x", "E"] and table["e"].sibling_count == 1 and table["d"].children_count == 2
    order = [r.node_id for r in R.preorder(R.tree_table(t), t).orderBy("preorder").collect()]
    assert order == ["ROOT", "a", "c", "d", "e", "f", "b"]
    lay = {r.node_id: r for r in R.radial_layout(t).collect()}
    assert lay["ROOT"].r == 0 and lay["e"].a1 <= lay["d"].a1 + 1e-9 and len(lay) == 7


def test_line_batches(spark):
    b = spark.createDataFrame([("x", f"b{i}", s) for i, s in enumerate((100, 90, 20, 300, 5))], "l1 string, block_id string, size int")
    assert {r.block_id: r.batch for r in R.line_batches(b).collect()} == {"b0": 0, "b1": 0, "b2": 1, "b3": 2, "b4": 3}


def test_hot_keys_give_the_same_results(spark, monkeypatch):
    import arborlake.operators.graph as g
    import arborlake.operators.tree as t
    import arborlake.runtime as r

    monkeypatch.setattr(r, "HOT_MIN_ROWS", 5)
    monkeypatch.setattr(g, "hot_keys", lambda c, k, n, total: r.hot_keys(c, k, n, total, least=5))
    monkeypatch.setattr(t, "find_hot", lambda df, k: r.hot_keys(df.filter(F.col(k).isNotNull()).groupBy(k).agg(F.count("*").alias("n")), k, "n", 10**6 // 10**6 * 100, least=5))
    nodes = spark.createDataFrame([(i,) for i in range(60)], "id int")
    edges = spark.createDataFrame([(7, i) for i in range(8, 50)] + [(50, 51)], "a int, b int")
    got = {x.id: x.component for x in G.components(nodes, edges).collect()}
    assert all(got[i] == 7 for i in range(7, 50)) and got[51] == 50 and got[3] == 3
    rows = [("ROOT", "", "ROOT", None, 0), ("a", "A", "L1", "ROOT", 0)] + [(f"n{i}", f"N{i}", "L3", "a", i) for i in range(40)]
    tr = spark.createDataFrame(rows, "node_id string, label string, level string, parent_id string, ord long")
    table = {x.node_id: x for x in R.tree_table(tr).collect()}
    assert len(table) == 42 and all(table[f"n{i}"].path_labels == ["", "A", f"N{i}"] and table[f"n{i}"].sibling_count == 39 for i in range(40))
    assert R.level_jumps(tr).count() == 40


def test_flatten_depth_takes_all_depths_of_a_pass(spark):
    parent = {"r": None} | {f"n{i}": f"n{i - 1}" if i else "r" for i in range(30)} | {f"w{i}": "n29" for i in range(5)}
    parent |= {"x": "n9", "y": "n19", "z": "w0", "zz": "z"}

    def depth(t, n):
        return 0 if t[n] is None else 1 + depth(t, t[n])

    want = dict(parent)
    for _ in range(10):  # the reference's passes, parents first
        changed = False
        for n in list(want):
            kids = [c for c, p in want.items() if p == n]
            if want.get(n) and kids and len(kids) <= 3 and depth(want, n) >= 4:
                want |= {c: want[n] for c in kids}
                del want[n]
                changed = True
        if not changed:
            break
    t = spark.createDataFrame([(n, "", "L1", p, 0) for n, p in parent.items()], "node_id string, label string, level string, parent_id string, ord long")
    assert {r.node_id: r.parent_id for r in R.flatten_depth(t).collect()} == want


def test_child_labels_keep_large_parents(spark):
    from arborlake.plans.similarity_queries import child_labels

    rows = [("big", f"c{i}", f"l{i:03}") for i in range(250)] + [("small", "a", "y"), ("small", "b", "x"), (None, "c", "z")]
    got = {(r.parent_id, r.chunk): r.labels.split("|") for r in child_labels(spark.createDataFrame(rows, "parent_id string, child_id string, label string"), 100).collect()}
    assert sum((got["big", i] for i in range(3)), []) == [f"l{i:03}" for i in range(250)] and [len(got["big", i]) for i in range(3)] == [100, 100, 50]
    assert got["small", 0] == ["x", "y"] and got[None, 0] == ["z"] and len(got) == 5


def test_wn13_compares_with_the_next_49(spark, tmp_path):
    from arborlake.plans.ordered_queries import wn13

    spark.createDataFrame([(i, "s", "x") for i in range(60)], "doc_id long, source string, issuer_id string").write.parquet(str(tmp_path / "documents.parquet"))
    assert {tuple(r) for r in wn13(spark, str(tmp_path)).collect()} == {(i, j) for i in range(60) for j in range(i + 1, min(i + 50, 60))}


def test_cross_parent_pairs_take_l2_and_l3(spark):
    from arborlake.plans.tree_queries import cross_parent_pairs

    rows = [(f"{level}{i:03}", level, f"p{i % 3}", i) for level in ("L1", "L2", "L3", "L4") for i in range(70)]
    got = {tuple(r) for r in cross_parent_pairs(spark.createDataFrame(rows, "node_id string, level string, parent_id string, ord long"), 49).collect()}
    assert got == {(f"{level}{i:03}", f"{level}{j:03}") for level in ("L2", "L3") for i in range(70) for j in range(i + 1, min(i + 50, 70)) if (j - i) % 3}
