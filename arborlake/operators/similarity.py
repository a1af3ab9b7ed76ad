"""Vectors, exact neighbours of stated queries, adaptive thresholds and rerank merging."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborlake.runtime import Stage

#: Rows of the two sides of a task of the exact search.
SHARD_ROWS, BLOCK_ROWS = 65_536, 16_384


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalize(v: Column) -> Column:
    """VC-01: length one; a zero vector stays zero."""
    n = norm(v)
    return F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(0.0))


def cosine_raw(a: Column, b: Column) -> Column:
    """VC-12: cosine in -1..1; null, empty or zero vectors give 0."""
    n = norm(a) * norm(b)
    return F.coalesce(F.when(n > 0, dot(a, b) / n), F.lit(0.0))


def cosine_unit(a: Column, b: Column) -> Column:
    """VC-11: cosine mapped to 0..1 by (v + 1) / 2; null, empty or zero vectors give 0."""
    n = norm(a) * norm(b)
    return F.coalesce(F.when(n > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (dot(a, b) / n + 1) / 2))), F.lit(0.0))


def exact_knn(corpus: DataFrame, queries: DataFrame, k: int, key: str = "id", vector: str = "v", shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """VC-02: (id_a, id_b, sim, rank_pos) of the k nearest rows of the corpus by cosine for each query.

    Corpus and queries are cut into shards and blocks of bounded size, by their number of rows; each
    meeting of a block and a shard is a task of its own: one matrix product that leaves k rows a
    query. Rows are excluded by id, so equal vectors count. rank_pos starts at 0; ties take the
    smaller id. Zero vectors have similarity 0 to everything; rows without a vector drop out.
    """
    kind = corpus.schema[key].dataType.simpleString()
    side = lambda df: df.filter(F.col(vector).isNotNull()).select(F.col(key).alias("id"), l2_normalize(F.col(vector)).alias("v"))
    stage = Stage(corpus.sparkSession, "knn")
    right, n = stage.save(side(corpus), {"n": F.count(F.lit(1))})
    left, m = stage.save(side(queries), {"n": F.count(F.lit(1))})
    shards, blocks = max(1, -(-n["n"] // shard_rows)), max(1, -(-m["n"] // block_rows))
    every = lambda size: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(size - 1).cast("long")))
    right = right.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards))).withColumn("block", every(blocks))
    left = left.withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks))).withColumn("shard", every(shards))

    def matrix(t: pa.Table) -> np.ndarray:
        return t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(t), -1)

    def meet(b: pa.Table, a: pa.Table) -> pa.Table:
        i, j, sims = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if len(a) and len(b):
            x, y = matrix(a), matrix(b)
            for at in range(0, len(x), 512):
                s = x[at : at + 512] @ y.T
                some = min(k + 1, s.shape[1])
                kth = np.partition(s, s.shape[1] - some, 1)[:, -some]
                p, q = np.nonzero(s >= kth[:, None] - 1e-12)
                i.append(p + at)
                j.append(q)
                sims.append(s[p, q])
        ids = lambda t, rows: t.column("id").combine_chunks().take(pa.array(np.concatenate(rows)))
        one, two = ids(a, i), ids(b, j)
        return pa.table({"id_a": one, "id_b": two, "sim": pa.array(np.concatenate(sims))}).filter(pa.compute.not_equal(one, two))

    found = right.groupBy("shard", "block").cogroup(left.groupBy("shard", "block")).applyInArrow(meet, f"id_a {kind}, id_b {kind}, sim double")
    w = Window.partitionBy("id_a").orderBy(F.desc(F.round("sim", 12)), "id_b")
    return found.withColumn("rank_pos", F.row_number().over(w) - 1).filter(F.col("rank_pos") < k)


def adaptive_threshold(knn: DataFrame, local_k: int, min_sim: float) -> DataFrame:
    """VC-03: (id_a, local_thr) = max(min_sim, mean - population deviation of the top local_k)."""
    top = knn.filter(F.col("rank_pos") < local_k).groupBy("id_a").agg(F.avg("sim").alias("m"), F.stddev_pop("sim").alias("s"))
    return top.select("id_a", F.greatest(F.lit(min_sim), F.col("m") - F.col("s")).alias("local_thr"))


def similarity_edges(knn: DataFrame, local_k: int = 20, min_sim: float = 0.0, mutual: bool = False) -> DataFrame:
    """VC-04, VC-05: edges at or above both thresholds; is_mutual tells whether the reverse is among
    the neighbours too (before thresholds), false throughout when not asked for."""
    thr = adaptive_threshold(knn, local_k, min_sim)
    edges = knn.join(thr, "id_a").filter((F.col("sim") >= min_sim) & (F.col("sim") >= F.col("local_thr")))
    if not mutual:
        return edges.withColumn("is_mutual", F.lit(False))
    back = knn.select(F.col("id_a").alias("id_b"), F.col("id_b").alias("id_a"), F.lit(True).alias("_m"))
    return edges.join(back, ["id_a", "id_b"], "left").withColumn("is_mutual", F.coalesce("_m", F.lit(False))).drop("_m")


def rerank_scope(edges: DataFrame, scope: str, top_m: int = 5, margin: float = 0.02, min_rank: int = 10) -> DataFrame:
    """VC-07: edges to score again: all, the top m per source, or the top m suspicious ones (not
    mutual, barely above the threshold, or far down the list)."""
    if scope == "all":
        return edges
    if scope == "suspicious":
        edges = edges.filter(~F.col("is_mutual") | (F.col("sim") - F.col("local_thr") <= margin) | (F.col("rank_pos") >= min_rank))
    return edges.withColumn("_r", F.row_number().over(Window.partitionBy("id_a").orderBy(F.desc("sim"), "id_b"))).filter(F.col("_r") <= max(1, top_m)).drop("_r")


def merge_rerank(edges: DataFrame, scores: DataFrame, threshold: float, strict: bool = False) -> DataFrame:
    """VC-08, JN-02: edges with rerank_score and kept_by_rerank. A failed score is -1 and not kept;
    soft keeps kept and unscored edges, strict only kept ones."""
    s = scores.select("id_a", "id_b", F.coalesce("rerank_score", F.lit(-1.0)).alias("rerank_score")).withColumn("kept_by_rerank", F.col("rerank_score") >= threshold)
    kept = F.coalesce(F.col("kept_by_rerank"), F.lit(False))
    return edges.join(s, ["id_a", "id_b"], "left").filter(kept if strict else kept | F.col("rerank_score").isNull())


def out_degree_stats(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """VC-09: mean, median, p05 and p95 of the out-degree over all ids, those without edges too."""
    deg = ids.select("id_a").distinct().join(edges.groupBy("id_a").agg(F.count("*").alias("n")), "id_a", "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    return deg.agg(F.avg("n").alias("mean"), F.percentile("n", F.lit(0.5)).alias("median"), F.percentile("n", F.lit(0.05)).alias("p05"), F.percentile("n", F.lit(0.95)).alias("p95"))


def centroids(members: DataFrame, vectors: DataFrame, group: str, member: str, key: str = "id", vector: str = "v") -> DataFrame:
    """VC-10: (group, pos, x) mean of the members' vectors per dimension, members without a vector
    left out. Sums pre-aggregate, so a group of any size is spread."""
    joined = members.join(vectors.select(F.col(key).alias(member), F.col(vector).alias("_v")), member)
    return joined.select(group, F.posexplode("_v").alias("pos", "x")).groupBy(group, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))


def centroid_vectors(parts: DataFrame, group: str) -> DataFrame:
    """(group, v): the dimensions of centroids() folded into arrays; one short list per group."""
    return parts.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("v"))


def needs_vector(items: DataFrame, cache: DataFrame, key: str, vector: str) -> DataFrame:
    """VC-13: items without a cached vector, or with a zero one (norm below 1e-8)."""
    good = cache.filter(F.col(vector).isNotNull() & (norm(F.col(vector)) >= 1e-8)).select(key).distinct()
    return items.join(good, key, "left_anti")


def or_zero(v: Column, dim: int) -> Column:
    """VC-17: zero vector in place of a missing one."""
    return F.coalesce(v, F.array_repeat(F.lit(0.0), dim))


def blend(cos: Column, jac: Column, w_cos: float = 0.7, w_jac: float = 0.3) -> Column:
    """VC-14."""
    return cos * w_cos + jac * w_jac
