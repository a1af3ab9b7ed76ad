import numpy as np
import pytest

from arborlake.llm import neighbors as N


def brute(x, q, k):
    s = x[q] @ x.T
    s[np.arange(len(q)), q] = -9
    return [sorted(range(len(x)), key=lambda j: (-s[a, j], j))[:k] for a in range(len(q))]


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(60, 16))
    x = np.repeat(centres, 15, 0) + 0.25 * rng.normal(size=(900, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return x.astype(np.float32)


def frame(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, v array<float>")


def test_factor_one_is_exact(spark, clustered):
    df = frame(spark, clustered)
    rows = N.knn(df, df.filter("id % 20 = 0"), 16, k=5, factor=1.0, probe=0.2, shard_rows=128, leaf_rows=16).collect()
    q = list(range(0, 900, 20))
    want = {(a, b) for a, best in zip(q, brute(clustered, q, 5)) for b in best}
    assert {(r.query_id, r.id) for r in rows} == want


def test_relaxed_recall(spark, clustered):
    df = frame(spark, clustered)
    rows = N.knn(df, df.filter("id % 20 = 0"), 16, k=5, shard_rows=128, leaf_rows=16).collect()
    q = list(range(0, 900, 20))
    want = {(a, b) for a, best in zip(q, brute(clustered, q, 5)) for b in best}
    assert len({(r.query_id, r.id) for r in rows} & want) / len(want) >= 0.9


def test_equal_vectors_are_split_and_found(spark, monkeypatch):
    monkeypatch.setattr(N, "QUERIES_PER_TASK", 20)
    x = np.zeros((400, 4), np.float32)
    x[:300, 0] = 1  # three quarters of the rows in one point
    x[300:, 1] = np.cos(np.arange(100) / 50)
    x[300:, 2] = np.sin(np.arange(100) / 50)
    df = frame(spark, x)
    rows = N.knn(df, df, 4, k=3, factor=1.0, shard_rows=50, leaf_rows=8).collect()
    near = {}
    for r in rows:
        near.setdefault(r.query_id, []).append((r.rank, r.id))
        assert r.id != r.query_id
    assert len(near) == 400 and all(len(v) == 3 for v in near.values())
    assert [i for _, i in sorted(near[5])] == [0, 1, 2] and [i for _, i in sorted(near[0])] == [1, 2, 3]


def test_small_and_empty(spark):
    df = frame(spark, np.eye(3, dtype=np.float32))
    assert N.knn(df, df, 3, k=10).count() == 6
    assert N.knn(df.limit(0), df.limit(0), 3).count() == 0
    assert N.knn(df, df.limit(0), 3).count() == 0


def test_usable_vectors(spark):
    nan = float("nan")
    rows = [
        ("a", [3.0, 4.0], None, 1), ("a", [1.0, 0.0], None, 0), ("b", None, "[0, 2]", 1), ("c", [0.0, 0.0], None, 1), ("d", [nan, 1.0], None, 1), ("e", [1.0], None, 1),
        ("f", None, "oops", 1), ("g", None, None, 1), ("h", [None, 1.0], None, 1), (None, [1.0, 1.0], None, 1), ("i", [1.0, 1.0], None, 0), ("i", None, None, 2), ("a", [3.0, 4.0], None, 1), ("j", [1e30, 1e30], None, 1),
    ]
    df = spark.createDataFrame(rows, "sample_id string, vector array<float>, embedding string, loaded_at int")
    got = {r.id: [round(x, 4) for x in r.v] for r in N.usable_vectors(df, "sample_id", "vector", "embedding", "loaded_at", 2).collect()}
    assert got == {"a": [0.6, 0.8], "b": [0.0, 1.0], "j": [0.7071, 0.7071]}
