"""Ranks that hold up when one key owns a third of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborlake.runtime import Stage


def full_rank(df: DataFrame, key: str, order: list[Column], name: str = "rank", partitions: int | None = None, total: str | None = None, of: Column | None = None) -> DataFrame:
    """Row number from 1 of every row within its key, without one task per key.

    Rows are range-partitioned by key and order, so a hot key spans several partitions; each row
    ranks within its partition and key, and gets the count of the key's earlier partitions on top.
    total names a column for the number of rows of the key; with of, only rows for which it holds are
    counted, so the others get the number of those before them. Null keys form one group; rows that are equal
    in order take their ranks in the order of their hash, which spreads any number of them as well. Top-k uses rank filters instead, which Spark
    already limits before the shuffle.
    """
    stage = Stage(df.sparkSession, "rank")
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = stage.save(df.repartitionByRange(n, F.col(key), *order, F.xxhash64(*df.columns)).withColumn("_fr_p", F.spark_partition_id()))
    w = Window.partitionBy("_fr_p", key).orderBy(*order, F.xxhash64(*df.columns))
    local = placed.withColumn("_fr_r", F.row_number().over(w) if of is None else F.count_if(of).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    counts = placed.groupBy(F.col(key).alias("_fr_k"), F.col("_fr_p").alias("_fr_q")).agg((F.count("*") if of is None else F.count_if(of)).alias("_fr_n"))
    if total:
        counts = counts.withColumn("_fr_t", F.sum("_fr_n").over(Window.partitionBy("_fr_k")))
    before = counts.withColumn("_fr_o", F.coalesce(F.sum("_fr_n").over(Window.partitionBy("_fr_k").orderBy("_fr_q").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_fr_n")
    if total:
        before = before.withColumnRenamed("_fr_t", total)
    return local.join(before, F.col(key).eqNullSafe(F.col("_fr_k")) & (F.col("_fr_p") == F.col("_fr_q"))).withColumn(name, (F.col("_fr_r") + F.col("_fr_o")).cast("int")).drop("_fr_p", "_fr_r", "_fr_k", "_fr_q", "_fr_o")


def running_count(df: DataFrame, key: str, order: list[Column], flag: Column, name: str) -> DataFrame:
    """Running number of flagged rows within a key, in order: document-sized groups."""
    return df.withColumn(name, F.sum(flag.cast("int")).over(Window.partitionBy(key).orderBy(*order)))


def sliding_pairs(df: DataFrame, keys: list[str], order: list[Column], key: str, band: int) -> DataFrame:
    """WN-13: (id_a, id_b) of every row with each of the next band rows of its group, in order.

    Ranks span partitions and the join is on group and rank, so a hot group is spread over as many
    tasks as it has rows. Rows with a null group key are left out.
    """
    kept = df
    for k in keys:
        kept = kept.filter(F.col(k).isNotNull())
    named = kept.select(F.concat_ws("\x01", *keys).alias("_g"), F.col(key).alias("_id"), F.struct(*order_columns(order)).alias("_ord"))
    ranked = full_rank(named, "_g", [F.asc("_ord")], "_at")
    ahead = ranked.select(F.col("_g"), F.col("_id").alias("id_b"), F.explode(F.sequence(F.col("_at") - band, F.col("_at") - 1)).alias("_at"))
    return ranked.join(ahead, ["_g", "_at"]).select(F.col("_id").alias("id_a"), "id_b")


def order_columns(order: list[Column]) -> list[Column]:
    return [c.alias(f"o{i}") for i, c in enumerate(order)]
