"""Deterministic stratified sampling by hash order, risk sets and path quotas."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborlake.operators.ranking import full_rank


def hash_order(seed: str, key: str) -> Column:
    """Pseudo-random but reproducible sort key."""
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")))


def stratified(rows: DataFrame, stratum: str, key: str, ratio: Column, seed: str) -> DataFrame:
    """SM-01: max(1, ceil(n * ratio)) rows of every stratum in hash order. Ranks span partitions, so
    a stratum with a third of the rows is no single task."""
    sizes = rows.groupBy(F.col(stratum).alias("_s")).agg(F.count("*").alias("_n"))
    ranked = full_rank(rows.withColumn("_h", hash_order(seed, key)), stratum, [F.asc("_h"), F.asc(key)], "_r")
    quota = F.greatest(F.lit(1), F.ceil(F.col("_n") * ratio - 1e-9))
    return ranked.join(sizes, F.col(stratum).eqNullSafe(F.col("_s"))).filter(F.col("_r") <= quota).drop("_h", "_r", "_s", "_n")


def union_ids(*parts: DataFrame, key: str = "node_id") -> DataFrame:
    """SM-02: distinct ids of several sources."""
    return reduce(lambda a, b: a.union(b), [p.select(key) for p in parts]).distinct()


def force_in(sample: DataFrame, forced: DataFrame, rows: DataFrame, key: str = "node_id") -> DataFrame:
    """SM-03: the sample plus forced rows that are not in it."""
    extra = rows.join(forced.select(key).distinct(), key, "left_semi").join(sample.select(key), key, "left_anti")
    return sample.unionByName(extra)


def reasons(flags: dict[str, Column]) -> Column:
    """SM-04: names of the conditions that hold, in order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in flags.items()]))


def path_quota(paths: DataFrame, by: str, target: int = 40, least: int = 3) -> DataFrame:
    """SM-05: max(least, target * n / total rounded half to even) per category."""
    n = paths.groupBy(by).agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("t"))
    t = (total.first() or [0])[0] or 1
    return n.select(by, F.greatest(F.lit(least), F.bround(F.lit(float(target)) * F.col("n") / F.lit(float(t))).cast("int")).alias("quota"))


def pick_paths(paths: DataFrame, by: str, key: str, length: str, seed: str, target: int = 40, risk: DataFrame | None = None, fill: int = 50) -> DataFrame:
    """SM-06: per category two of its longest paths and the rest of its quota from the others, both
    in hash order; then paths at risk (risk: their keys) in hash order until fill paths are chosen;
    and the longest path of all."""
    h = hash_order(seed, key)
    longest = paths.groupBy(F.col(by).alias("_b")).agg(F.max(length).alias("_m"))
    rows = paths.join(longest, F.col(by) == F.col("_b")).withColumn("_h", h)
    w = Window.partitionBy(by).orderBy("_h", key)
    two = rows.filter(F.col(length) == F.col("_m")).withColumn("_r", F.row_number().over(w)).filter("_r <= 2").select(key)
    quota = path_quota(paths, by, target).withColumnRenamed(by, "_q")
    taken = two.join(paths.select(key, by), key).groupBy(F.col(by).alias("_t")).agg(F.count("*").alias("_k"))
    others = rows.join(two, key, "left_anti").withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= target)
    rest = others.join(quota, F.col(by) == F.col("_q")).join(taken, F.col(by) == F.col("_t"), "left").filter(F.col("_r") <= F.col("quota") - F.coalesce("_k", F.lit(0))).select(key)
    top = paths.orderBy(F.desc(length), key).limit(1).select(key)
    chosen = two.union(rest).distinct()
    if risk is not None:
        more = max(0, fill - chosen.count())  # the size of the sample is the operator
        at_risk = paths.join(risk.select(key).distinct(), key, "left_semi").join(chosen, key, "left_anti")
        chosen = chosen.union(at_risk.select(key, h.alias("_h")).orderBy("_h", key).limit(more).select(key))
    return chosen.union(top).distinct()


def retry_clean(raw: DataFrame, done: DataFrame, key: str = "sample_id", error: str = "error", seq: str = "seq") -> DataFrame:
    """SO-03: failures dropped; of successful ids known as done the last record stays, others all stay."""
    good = raw.filter(F.col(error).isNull())
    known = good.join(done.select(key).distinct(), key, "left_semi")
    last = known.groupBy(key).agg(F.max(seq).alias(seq))
    return good.join(last, [key, seq], "left_semi").unionByName(good.join(done.select(key).distinct(), key, "left_anti"))


def progress(total: DataFrame, done: DataFrame, failed: DataFrame, key: str = "sample_id") -> DataFrame:
    """SO-02, RP-08: counts of done, failed (and not done) and untouched ids, percentage and bar."""
    flags = total.select(key).distinct().join(done.select(key).distinct().withColumn("_d", F.lit(1)), key, "left").join(failed.select(key).distinct().withColumn("_f", F.lit(1)), key, "left")
    n = flags.agg(F.count("*").alias("total"), F.count("_d").alias("done"), F.count_if(F.col("_d").isNull() & F.col("_f").isNotNull()).alias("failed"), F.count_if(F.col("_d").isNull() & F.col("_f").isNull()).alias("untouched"))
    pct = F.when(F.col("total") > 0, F.col("done") / F.col("total") * 100).otherwise(0.0)
    full = F.floor(pct / 5).cast("int")
    return n.withColumn("percent", F.round(pct, 1)).withColumn("bar", F.concat(F.repeat(F.lit("█"), full), F.repeat(F.lit("░"), 20 - full)))
