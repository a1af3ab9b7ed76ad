"""P2: the k most similar vectors of every query vector, by vantage-point trees per shard.

Vectors are scaled to length one; the distance sqrt(2 - 2 cos) is a metric with the order of the
cosine. A small vantage-point tree over a bounded sample cuts the space into shards; each shard
packs its rows with a vantage-point tree of its own into one block. A query enters every branch
whose triangle-inequality margin (how far the query is beyond the branch's bound) is small enough:

1. probe: branches with a margin up to a fixed small width give a first k-th distance tau;
2. search: the branches with a margin up to factor * tau that the probe left out.

With factor 1 every branch that can hold a nearer vector is entered, so the result is exact; smaller
factors prune more and lose little, because in many dimensions margins overstate what lies beyond.
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlake.runtime import Stage, require_columns

SHARD_ROWS = 16_384
#: Beyond MAX_SHARDS shards blocks grow up to so many rows (64 MB of 64 floats) before a region is split by
#: hash: up to about a thousand million rows a query's work grows with the logarithm of the rows only.
BLOCK_ROWS = 262_144
MAX_SHARDS = 4_096
LEAF_ROWS = 256
#: Rows of the sample that places the shards' cuts, at most; every row is indexed nevertheless.
SAMPLE_ROWS = 32_768
QUERIES_PER_TASK = 50_000
_SUB = 1 << 20


def usable_vectors(rows: DataFrame, key: str, vector: str, text: str, order: str, dim: int) -> DataFrame:
    """(id, v) of the newest row of every non-null key: v from the vector column, or when that is
    null from the JSON text. Rows whose v has not dim finite numbers, or zeros only, drop out after
    the newest was chosen. Equal times: the larger vector counts, so copies change nothing."""
    require_columns(rows, (key, vector, text, order), "vectors")
    v = F.coalesce(F.col(vector).cast("array<float>"), F.from_json(text, "array<float>"))
    newest = rows.filter(F.col(key).isNotNull()).select(F.col(key).alias("id"), v.alias("v"), F.col(order).alias("at")).groupBy("id").agg(F.max_by("v", F.struct("at", "v")).alias("v"))
    return unit_vectors(newest.filter(F.size("v") == dim), dim)


def unit_vectors(rows: DataFrame, dim: int) -> DataFrame:
    """(id, v) with v scaled to length one; rows without dim finite numbers or all zero drop out."""
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column("v")
            keep = np.array(pa.compute.equal(pa.compute.list_value_length(col), dim).fill_null(False))
            b = b.filter(pa.array(keep))
            x = b.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)  # null elements are NaN
            top = np.abs(x).max(1) if len(x) else np.zeros(0)
            good = np.isfinite(top) & (top > 0)
            x = x[good] / top[good, None]
            x /= np.sqrt((x * x).sum(1, keepdims=True))
            yield pa.RecordBatch.from_arrays([b.column("id").filter(pa.array(good)), _lists(x.astype(np.float32))], names=["id", "v"])

    return rows.select("id", "v").mapInArrow(run, f"id {kind}, v array<float>")


def _lists(x: np.ndarray) -> pa.Array:
    n, dim = x.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * dim + 1, dim, dtype=np.int32)), pa.array(x.ravel()))


def _matrix(col, dim: int) -> np.ndarray:
    return col.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim) if isinstance(col, pa.ChunkedArray) else col.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _distance(x: np.ndarray, point: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (x @ point)))


def _vantage_point(x: np.ndarray, rng: np.random.Generator, candidates: int = 6) -> np.ndarray:
    """The one of a few points whose distances to the others spread most."""
    some = x[rng.integers(len(x), size=min(len(x), 512))]
    picks = x[rng.integers(len(x), size=candidates)]
    return picks[np.argmax([_distance(some, p).std() for p in picks])]


class VantageTree:
    """Nodes in arrays. Node i has point, inner (largest distance of the near half), outer (smallest
    of the far half) and children; a child below 0 is the leaf ~child, rows order[start:stop]."""

    def __init__(self, points, inner, outer, children, starts, order):
        self.points, self.inner, self.outer, self.children, self.starts, self.order = points, inner, outer, children, starts, order

    @classmethod
    def build(cls, x: np.ndarray, leaf_rows: int, seed: int = 7, halves: bool = False) -> VantageTree:
        """halves: one cut value for both sides, so that rows outside x can be placed as well."""
        rng = np.random.default_rng(seed)
        points, inner, outer, children, starts, order = [], [], [], [], [0], []
        todo: list[tuple[np.ndarray, int, int]] = [(np.arange(len(x)), -1, 0)]
        while todo:
            rows, parent, side = todo.pop()
            if len(rows) <= leaf_rows:
                me = ~(len(starts) - 1)
                order.append(rows)
                starts.append(starts[-1] + len(rows))
            else:
                me = len(points)
                point = _vantage_point(x[rows], rng)
                d = _distance(x[rows], point)
                at = np.argsort(d, kind="stable")
                half = len(rows) // 2
                near, far = d[at[half - 1]], d[at[half]]
                points.append(point)
                inner.append(near)
                outer.append(near if halves else far)
                children.append([0, 0])
                todo.append((rows[at[half:]], me, 1))
                todo.append((rows[at[:half]], me, 0))
            if parent >= 0:
                children[parent][side] = me
        dim = x.shape[1]
        return cls(np.array(points, np.float32).reshape(-1, dim), np.array(inner, np.float64), np.array(outer, np.float64), np.array(children, np.int32).reshape(-1, 2), np.array(starts, np.int64), np.concatenate(order) if order else np.zeros(0, np.int64))

    @property
    def leaves(self) -> int:
        return len(self.starts) - 1

    def place(self, x: np.ndarray) -> np.ndarray:
        """The leaf every row belongs to (trees built with halves)."""
        leaf = np.zeros(len(x), np.int32)
        todo = [(0 if len(self.points) else -1, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                leaf[rows] = ~node
            elif len(rows):
                near = _distance(x[rows], self.points[node]) <= self.inner[node]
                todo += [(self.children[node][0], rows[near]), (self.children[node][1], rows[~near])]
        return leaf

    def enter(self, q: np.ndarray, width: np.ndarray, margin: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(leaf, query rows, margins) of all leaves whose margin is within the width of the query."""
        todo = [(0 if len(self.points) else -1, np.arange(len(q)), np.zeros(len(q)) if margin is None else margin)]
        while todo:
            node, rows, so_far = todo.pop()
            if not len(rows):
                continue
            if node < 0:
                yield ~node, rows, so_far
                continue
            d = _distance(q[rows], self.points[node]).astype(np.float64)
            for side, beyond in ((0, d - self.inner[node]), (1, self.outer[node] - d)):
                m = np.maximum(so_far, beyond)
                go = m <= width[rows] + 1e-5  # float rounding
                todo.append((self.children[node][side], rows[go], m[go]))

    def dump(self, x: np.ndarray) -> bytes:
        out = io.BytesIO()
        np.savez(out, points=self.points, inner=self.inner, outer=self.outer, children=self.children, starts=self.starts, x=x[self.order])
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> tuple[VantageTree, np.ndarray]:
        z = np.load(io.BytesIO(data))
        return cls(z["points"], z["inner"], z["outer"], z["children"], z["starts"], None), z["x"]


def _search(block: bytes, q: np.ndarray, bound: np.ndarray, wide: np.ndarray, margin: np.ndarray, probe: float, first: bool, k: int):
    """(query row, row of the block, cosine) candidates of one block. bound: cosine to reach."""
    tree, x = VantageTree.load(block)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    best = bound.copy()
    for leaf, rows, m in tree.enter(q, wide, margin):
        if not first:  # the probe has been here already
            new = m > probe + 1e-5
            rows = rows[new]
            if not len(rows):
                continue
        lo, hi = tree.starts[leaf], tree.starts[leaf + 1]
        for at in range(0, len(rows), 8192):
            some = rows[at : at + 8192]
            s = q[some] @ x[lo:hi].T
            if first and hi - lo > k + 1:
                kth = np.partition(s, s.shape[1] - k - 1, 1)[:, -k - 1]  # one more: the query itself
                best[some] = np.maximum(best[some], kth)
            i, j = np.nonzero(s >= best[some, None] - 1e-6)
            found.append((some[i], j + lo, s[i, j]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
    a, b, s = (np.concatenate(z) for z in zip(*found))
    if first:
        keep = s >= best[a] - 1e-6
        a, b, s = a[keep], b[keep], s[keep]
    at = np.lexsort((-s, a))
    a, b, s = a[at], b[at], s[at]
    nth = np.arange(len(a)) - np.searchsorted(a, a)
    keep = (nth <= k) | (s >= s[np.minimum(np.searchsorted(a, a) + k, len(s) - 1)] - 1e-6)  # ties stay
    return a[keep], b[keep], s[keep]


def knn(corpus: DataFrame, queries: DataFrame, dim: int, k: int = 10, factor: float = 0.24, probe: float = 0.7, shard_rows: int = SHARD_ROWS, leaf_rows: int = LEAF_ROWS, stage: Stage | None = None, total: int | None = None) -> DataFrame:
    """(query_id, id, similarity, rank) of the k rows of corpus most similar to each query.

    corpus and queries: id (unique) and v, vectors of length one (unit_vectors). A row is never its
    own neighbour: equal ids are left out, equal vectors under other ids are not. Ties take the
    smaller id. factor relaxes the pruning (1: exact), probe is the width of the first step in
    standard deviations of the distances. A region that holds many rows or equal vectors is split by
    the hash of the id, so no block exceeds about shard_rows (BLOCK_ROWS in very large tables); queries of
    a block are split as well.
    Empty tables give an empty result; fewer than k others give fewer rows.
    """
    spark = corpus.sparkSession
    stage = stage or Stage(spark, "neighbors")
    kind = corpus.schema["id"].dataType.simpleString()
    n = corpus.count() if total is None else total
    if not n:
        return spark.createDataFrame([], f"query_id {kind}, id {kind}, similarity float, rank int")
    cuts = max(0, min(int(math.log2(MAX_SHARDS)), math.ceil(math.log2(max(1, n / shard_rows)))))
    block_rows = max(shard_rows, min(BLOCK_ROWS, n // MAX_SHARDS))
    want = min(SAMPLE_ROWS, max(4096, 256 << cuts))
    step = max(1, n // want)
    sample = corpus if step == 1 else corpus.filter(F.pmod(F.xxhash64("id"), F.lit(step)) == 0)
    x = _matrix(sample.select("v").limit(2 * want).toArrow().column("v"), dim)
    if not len(x):
        x = np.zeros((1, dim), np.float32)
    top = VantageTree.build(x, max(1, math.ceil(len(x) / (1 << cuts))), halves=True)
    held = np.bincount(top.place(x), minlength=top.leaves) * (n / len(x))
    parts = np.maximum(1, np.ceil(held / (1.5 * block_rows))).astype(np.int64)
    width = float(probe * _distance(x, _vantage_point(x, np.random.default_rng(3))).std())
    shared = spark.sparkContext.broadcast((top, parts))  # at most 4,095 points

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, _ = shared.value
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), pa.array(tree.place(_matrix(b.column("v"), dim)), pa.int64())], names=["id", "v", "leaf"])

    def pack(t: pa.Table) -> pa.Table:
        m = np.ascontiguousarray(_matrix(t.column("v"), dim))
        tree = VantageTree.build(m, leaf_rows)
        ids = pa.array([t.column("id").combine_chunks().take(pa.array(tree.order)).to_pylist()], pa.list_(t.schema.field("id").type))
        return pa.table({"shard": t.column("shard")[:1], "ids": ids, "block": pa.array([tree.dump(m)], pa.binary())})

    split = F.element_at(F.lit(parts.tolist()).cast("array<long>"), (F.col("leaf") + 1).cast("int"))
    placed = corpus.mapInArrow(place, f"id {kind}, v array<float>, leaf long").withColumn("shard", F.col("leaf") * _SUB + F.pmod(F.xxhash64("id"), split)).drop("leaf")
    blocks = stage.save(placed.groupBy("shard").applyInArrow(pack, f"shard long, ids array<{kind}>, block binary"))

    def route(first: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tree, split_into = shared.value
            for b in batches:
                q, tau = _matrix(b.column("v"), dim), b.column("tau").to_numpy(zero_copy_only=False)
                wide = np.full(len(q), width) if first else np.maximum(width, factor * tau)
                for leaf, rows, m in tree.enter(q, wide):
                    if not first:  # nothing new when the query needs no more than the probe's width
                        new = wide[rows] > width
                        rows, m = rows[new], m[new]
                    for part in range(split_into[leaf]):
                        some = b.take(pa.array(rows))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), leaf * _SUB + part), pa.int64()), some.column("id"), some.column("v"), pa.array(tau[rows], pa.float64()), pa.array(m)], names=["shard", "qid", "v", "tau", "margin"])
        return run

    def search(first: bool):
        def run(block: pa.Table, asked: pa.Table) -> pa.Table:
            if not len(block) or not len(asked):
                return pa.table({"qid": asked.column("qid")[:0], "id": asked.column("qid")[:0], "s": pa.array([], pa.float32())})
            q, tau = np.ascontiguousarray(_matrix(asked.column("v"), dim)), asked.column("tau").to_numpy()
            wide = np.full(len(q), width) if first else np.maximum(width, factor * tau)
            bound = np.full(len(q), -2.0, np.float32) if first else (1 - tau * tau / 2).astype(np.float32)
            a, b, s = _search(block.column("block")[0].as_buffer().to_pybytes(), q, bound, wide, asked.column("margin").to_numpy(), width, first, k)
            ids = block.column("ids").combine_chunks().flatten()
            out = pa.table({"qid": asked.column("qid").combine_chunks().take(pa.array(a)), "id": ids.take(pa.array(b)), "s": pa.array(s.astype(np.float32))})
            return out.filter(pa.compute.not_equal(out.column("qid"), out.column("id")))
        return run

    def step_of(asked: DataFrame, first: bool) -> DataFrame:
        # staged, so that routing runs once for the counts and the search
        routed = stage.save(asked.mapInArrow(route(first), f"shard long, qid {kind}, v array<float>, tau double, margin double"))
        counts = routed.groupBy("shard").agg(F.ceil(F.count("*") / QUERIES_PER_TASK).cast("int").alias("chunks"))
        big = {r.shard: r.chunks for r in counts.filter("chunks > 1").collect()}  # one row per busy block at most
        chunk, spread = F.lit(0), blocks.withColumn("chunk", F.lit(0))
        if big:
            table = F.broadcast(spark.createDataFrame(list(big.items()), "shard long, chunks int"))
            routed = routed.join(table, "shard", "left")
            chunk = F.pmod(F.xxhash64("qid"), F.coalesce("chunks", F.lit(1))).cast("int")
            spread = blocks.join(table, "shard", "left").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.coalesce("chunks", F.lit(1)) - 1))).drop("chunks")
        routed = routed.withColumn("chunk", chunk).select("shard", "chunk", "qid", "v", "tau", "margin")
        return spread.groupBy("shard", "chunk").cogroup(routed.groupBy("shard", "chunk")).applyInArrow(search(first), f"qid {kind}, id {kind}, s float")

    def top_k(found: DataFrame) -> DataFrame:
        """Keeps the k best per query; max_by-like partial aggregation is not needed, as every block
        sends at most about k rows a query."""
        from pyspark.sql import Window

        rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("s"), "id"))
        return found.withColumn("rank", rank).filter(F.col("rank") <= k)

    asked = stage.save(queries.select("id", "v", F.lit(2.0).alias("tau")))
    probed = stage.save(top_k(step_of(asked, True)))
    kth = probed.filter(F.col("rank") == k).select(F.col("qid").alias("id"), F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("s").cast("double"))).alias("t"))
    bounded = asked.drop("tau").join(kth, "id", "left").select("id", "v", F.coalesce("t", F.lit(2.0 / factor)).alias("tau"))
    more = step_of(bounded, False)
    final = top_k(probed.drop("rank").unionByName(more))
    return final.select(F.col("qid").alias("query_id"), "id", F.col("s").alias("similarity"), "rank")
