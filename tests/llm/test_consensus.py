import random

import numpy as np
import pytest

from arborlake.llm.consensus import consensus, newest_ratings, ordinal_alpha, triplet_rates


@pytest.fixture(scope="module")
def planted():
    rng = random.Random(5)
    careful, bad = [f"good{i}" for i in range(6)], ["noise", "copy1", "copy2"]
    rows, truth = [], {}
    for i in range(600):
        t = truth[f"s{i}"] = rng.randint(1, 5)
        joint = rng.randint(1, 5)
        for j in rng.sample(careful, 4) + bad:
            if j in careful:
                v = t if rng.random() < 0.8 else rng.randint(1, 5)
            else:
                v = rng.randint(1, 5) if j == "noise" else joint
            rows.append((f"s{i}", j, v))
    return rows, truth


def test_planted_truth_and_reliability(spark, planted):
    rows, truth = planted
    found, judges = consensus(spark.createDataFrame(rows, "item string, rater string, q int"), ["q"])
    got = {r.item: r.consensus for r in found.collect()}
    assert len(got) == 600 and np.mean([got[k] == v for k, v in truth.items()]) > 0.9
    assert {r.rater for r in judges.collect() if r.careful} == {f"good{i}" for i in range(6)}


def test_newest_only_range_and_nulls(spark):
    rows = [("a", "x", 5, 1), ("a", "x", None, 2), ("a", "y", 9, 1), ("a", "z", 3, None), (None, "x", 1, 1), ("b", None, 1, 1), ("a", "z", 3, None)]
    df = spark.createDataFrame(rows, "s string, j string, q int, at int")
    got = {(r.item, r.rater): r.q for r in newest_ratings(df, "s", "j", {"q": "q"}, "at").collect()}
    assert got == {("a", "x"): None, ("a", "y"): None, ("a", "z"): 3}


def test_ties_and_no_careful_rater(spark):
    df = spark.createDataFrame([("a", "x", 4), ("a", "y", 2), ("b", "x", None)], "item string, rater string, q int")
    found, _ = consensus(df, ["q"])
    assert [(r.item, r.consensus) for r in found.collect()] == [("a", 2)]


def test_empty(spark):
    df = spark.createDataFrame([], "item string, rater string, q int")
    found, judges = consensus(df, ["q"])
    assert found.count() == 0 and judges.count() == 0 and ordinal_alpha(df, ["q"]).count() == 0


def test_triplets_need_common_items():
    z = np.zeros((3, 3))
    assert np.isnan(triplet_rates(z, z, np.zeros((3, 5)))).all()


def test_alpha_against_definition(spark):
    rng = random.Random(1)
    rows = [(i, j, rng.choice([1, 2, 2, 3, 5])) for i in range(40) for j in range(rng.randint(1, 4))]
    got = ordinal_alpha(spark.createDataFrame([(str(i), str(j), v) for i, j, v in rows], "item string, rater string, q int"), ["q"]).first().alpha
    units = {}
    for i, _, v in rows:
        units.setdefault(i, []).append(v)
    units = {k: v for k, v in units.items() if len(v) > 1}
    n = {v: sum(u.count(v) for u in units.values()) for v in range(1, 6)}
    d = lambda a, b: (sum(n[g] for g in range(min(a, b), max(a, b) + 1)) - (n[a] + n[b]) / 2) ** 2 if a != b else 0
    total = sum(n.values())
    do = sum(d(a, b) / (len(u) - 1) for u in units.values() for x, a in enumerate(u) for y, b in enumerate(u) if x != y) / total
    de = sum(n[a] * n[b] * d(a, b) for a in n for b in n) / (total * (total - 1))
    assert abs(got - (1 - do / de)) < 1e-9
