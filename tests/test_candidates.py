"""Candidates of children by sorted numbers: whole results, without scoring every pair."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from arborlake.operators import graph as G

INF, NAN = float("inf"), float("nan")


def most_rows(spark, run):
    """What run returns, and the most rows that any step of a plan it ran gave out."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    got = run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    most, ran = 0, store.executionsList()
    for i in range(before, ran.size()):
        e = ran.apply(i).executionId()
        values, nodes = store.executionMetrics(e), store.planGraph(e).allNodes()
        for j in range(nodes.size()):
            metrics = nodes.apply(j).metrics()
            for m in (metrics.apply(x) for x in range(metrics.size())):
                if m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                    most = max(most, int(values.apply(m.accumulatorId()).replace(",", "")))
    return got, most


@pytest.fixture(scope="module")
def shop(spark, tmp_path_factory):
    """Customers and suppliers, most of them in one nation, with equal balances."""
    rng, d = random.Random(8), str(tmp_path_factory.mktemp("shop"))
    nation = lambda: 1 if rng.random() < 0.9 else rng.randint(2, 4)
    c = [(i, nation(), rng.randint(-99999, 999999) / 100) for i in range(600)]
    s = [(i, nation(), rng.choice([rng.randint(-99999, 999999) / 100, 6000.0, c[i % 600][2]])) for i in range(1200)]
    c.append((600, 9, 5.0))  # nobody there
    spark.createDataFrame(c, "c_custkey long, c_nationkey int, c_acctbal double").write.parquet(f"{d}/customer.parquet")
    spark.createDataFrame(s, "s_suppkey long, s_nationkey int, s_acctbal double").write.parquet(f"{d}/supplier.parquet")
    return d, c, s


def ranked(c, s, key):
    """{child: [(score, parent)]}, best first."""
    return {i: sorted(((1 - abs(x - y) / 11000, p) for p, g, y in s if g == n), key=lambda t: (-round(t[0], 9), key(t[1]))) for i, n, x in c}


def test_margin_of_candidates(spark, shop):
    d, c, s = shop
    got, most = most_rows(spark, lambda: entry.queries()["ev04_candidate_margin"](spark, d).collect())
    want = {i: r[0][0] - (r[1][0] if len(r) > 1 else 0) for i, r in ranked(c, s, int).items() if r}
    assert {r.child_id: r.margin for r in got} == pytest.approx(want, abs=1e-6)
    assert most < 30_000  # 540,000 pairs share the nation


def test_assigned_parents(spark, shop):
    d, c, s = shop
    got, most = most_rows(spark, lambda: entry.queries()["gr07_assign_parents"](spark, d).collect())
    want = {}
    for i, r in ranked(c, [x for x in s if x[2] > 5000], str).items():
        picks = [str(p) for _, p in r[:5] if p % 4 == 0]
        if not r:
            want[i] = ("NEW_" + hashlib.md5(str(i).encode()).hexdigest()[:8], "create")
        elif r[0][0] >= 0.98:
            want[i] = (str(r[0][1]), "hard_assign")
        else:
            want[i] = (max(picks), "model_assign") if picks else (str(r[0][1]), "fallback_top1")
    assert {r.child_id: (r.parent_id, r.decision) for r in got} == want and len(got) == len(c)
    assert {x for _, x in want.values()} == {"create", "hard_assign", "model_assign", "fallback_top1"}
    assert most < 30_000  # over 200,000 pairs share the nation


def test_top_candidates(spark, shop):
    d, c, s = shop
    got, most = most_rows(spark, lambda: entry.queries()["st02_top_candidates"](spark, d).collect())
    want = {(i, p, at) for i, r in ranked(c, [x for x in s if x[2] > 5000], str).items() for at, (_, p) in enumerate(r[:5], 1)}
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert most < 30_000  # over 200,000 pairs share the nation


@pytest.mark.parametrize("kind", ["close", "odd", "few"])
def test_nearest_candidates_are_those_of_all_pairs(spark, kind):
    rng = random.Random(kind)
    number = {
        "close": lambda: rng.uniform(0, 1e-3),  # many tie at nine decimals
        "odd": lambda: rng.choice([None, NAN, INF, -INF, *[rng.randint(-9, 9) / 2 for _ in range(16)]]),
        "few": lambda: rng.choice([None, NAN, 1.0, 2.0]),
    }[kind]
    cats = list(range(12)) + [None] if kind == "few" else [0, 1]
    rows = lambda n: [(i, rng.choice(cats), number()) for i in range(n)]
    c = spark.createDataFrame([*rows(150), (7, 0, 1.0), (7, 1, 1.0)], "node_id long, l1 int, a double")
    p = spark.createDataFrame(rows(60 if kind == "few" else 600), "node_id long, l1 int, b double")
    rate = lambda a, b: 1 - F.abs(a - b) / 11000
    seen = lambda df: sorted((r.child_id, r.rank, r.parent_id, repr(r.score)) for r in df.collect())
    assert seen(G.scored_candidates(c, p, rate, 4, near=("a", "b"))) == seen(G.scored_candidates(c, p, rate(F.col("c_a"), F.col("p_b")), 4))
