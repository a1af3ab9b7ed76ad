import random

from arborlake.llm.mixing import balance, plan_shares

T = "source string, target_share double, max_repeats int"


def test_shares_caps_and_determinism(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["big", " Big", "BIG", "small-source", "tiny"] if i % 3 else ["big"]), rng.randint(1, 400)) for i in range(3000)]
    df = spark.createDataFrame(rows, "key long, source string, size long")
    t = spark.createDataFrame([("big", 0.5, 1), ("small_source", 0.3, 2), ("tiny", 0.15, 3), ("none", 0.05, 1), ("tiny", 0.1, 3)], T)
    copies, report = balance(df, t)
    got = {r["source"]: r for r in report}
    for s, share in (("big", 0.5 / 0.95), ("small_source", 0.3 / 0.95), ("tiny", 0.15 / 0.95)):
        assert abs(got[s]["actual_share"] - share) < 0.003 and got[s]["most_copies"] <= got[s]["max_repeats"]
    assert got["none"]["actual_share"] == 0 and all(r["converged"] for r in report)
    _, early = balance(df, t, steps=1)
    assert not all(r["converged"] for r in early)
    again, _ = balance(df.repartition(3).orderBy("size"), t)
    assert sorted((r.key, r.copies) for r in copies.collect()) == sorted((r.key, r.copies) for r in again.collect())
    assert copies.count() == 3000


def test_odd_records(spark):
    df = spark.createDataFrame([(1, None, 5), (2, "a", None), (3, "a", 0), (4, "a", 10), (5, "b", 10), (6, "other", 9)], "key long, source string, size long")
    t = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1), (None, 0.1, 1), ("c", None, 1)], T)
    copies, report = balance(df, t)
    assert {r.key: r.copies for r in copies.collect()} == {1: 0, 2: 0, 3: 0, 4: 1, 5: 1, 6: 0}
    assert [round(r["actual_share"], 3) for r in report] == [0.5, 0.5]


def test_empty(spark):
    df = spark.createDataFrame([], "key long, source string, size long")
    copies, report = balance(df, spark.createDataFrame([("a", 1.0, 1)], T))
    assert copies.count() == 0 and report[0]["actual_share"] == 0
    copies, report = balance(df, spark.createDataFrame([], T))
    assert copies.count() == 0 and report == []


def test_plan_with_a_given_total():
    p = plan_shares({"a": (100, 10), "b": (10, 1)}, {"a": (0.5, 1), "b": (0.5, 2)}, total=100)
    assert p["a"]["goal"] == 50 and p["b"]["goal"] == 20
