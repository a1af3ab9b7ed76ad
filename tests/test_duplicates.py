import random

from pyspark.sql import functions as F

from arborlake.operators import duplicates as U

NODE = "node_id string, parent_id string, level string, label string, v array<double>"


def planted(seed=3, n=160):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(14)]
    rows = []
    for i in range(n):
        v = [rng.gauss(0, 1) for _ in range(3)]
        rows.append((f"n{i:03}", rng.choice(["p", "p", "p", "q", "r", None]), "L3", " ".join(rng.sample(words, rng.randint(0, 5))), rng.choice([v, v, v, None, [0.0, 0.0, 0.0]])))
    rows += [("c1", "p", "L3", "w1 w2", [1.0, 0.0, 0.0]), ("c0", "p", "L3", "w2 w1", [1.0, 0.0, 0.0]), ("c2", "p", "L3", None, None), ("c3", "p", "L3", "", None)]
    return rows


def brute(rows, overlap, cosine, same_parent=True):
    import math

    def over(a, b):
        x, y = set((a or "").split()), set((b or "").split())
        return len(x & y) / len(x | y) if x | y else 0.0

    def cos(a, b):
        if not a or not b or not any(a) or not any(b):
            return 0.0
        return (sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b)) + 1) / 2

    cls = {}
    for r in sorted(rows):
        cls.setdefault((r[1], tuple(sorted(set((r[3] or "").split()))), tuple(r[4]) if r[4] else None), r[0])
    reps = [r for r in rows if r[1] is not None and r[0] in set(cls.values())]
    return {tuple(sorted((a[0], b[0]))) for a in reps for b in reps if a[0] < b[0] and a[1] == b[1] and (over(a[3], b[3]) >= overlap or cos(a[4], b[4]) >= cosine)}


def test_siblings_against_brute_force(spark, monkeypatch):
    rows = planted()
    df = spark.createDataFrame(rows, NODE).withColumn("id", F.lit("clash"))
    for block in (2_048, 16):  # one block, and many blocks of one parent
        monkeypatch.setattr(U, "BLOCK_ROWS", block)
        pairs, members = U.sibling_duplicates(df, overlap=0.5, cosine=0.9)
        assert {(r.id_a, r.id_b) for r in pairs.collect()} == brute(rows, 0.5, 0.9)
    got = {r.id: r.class_id for r in members.collect()}
    assert got["c1"] == "c0" and got["c3"] == "c2" and len(got) == sum(r[1] is not None for r in rows)


def test_cross_parents_and_merges(spark):
    rows = [("a", "p", "L2", "x y", None), ("b", "q", "L2", "y x", None), ("c", "q", "L2", "x y", None), ("d", "r", "L3", "x y", None), ("e", None, "L2", "x y", None)]
    df = spark.createDataFrame(rows, NODE)
    assert {tuple(r) for r in U.cross_parent_duplicates(df, [F.col("node_id")]).collect()} == {("a", "b"), ("a", "c")}
    assert {tuple(r) for r in U.cross_parent_duplicates(df, [F.col("node_id")], band=1).collect()} == {("a", "b")}
    pairs, members = U.sibling_duplicates(df)
    assert {tuple(r) for r in U.merge_duplicates(pairs, members).collect()} == {("c", "b")}
    near = spark.createDataFrame([("m", "p", "L2", "u v w x", None), ("n", "p", "L2", "u v w x y", None), ("o", "p", "L2", "u v w x", None)], NODE)
    pairs, members = U.sibling_duplicates(near)
    no = spark.createDataFrame([("m", "n", False)], "id_a string, id_b string, merge boolean")
    assert {tuple(r) for r in U.merge_duplicates(pairs, members, no).collect()} == {("o", "m")}
    assert {tuple(r) for r in U.merge_duplicates(pairs, members).collect()} == {("o", "m"), ("n", "m")}


def test_empty(spark):
    df = spark.createDataFrame([], NODE)
    pairs, members = U.sibling_duplicates(df)
    assert pairs.count() == members.count() == U.cross_parent_duplicates(df, [F.col("node_id")]).count() == U.merge_duplicates(pairs, members).count() == 0
