"""Column order, upserts, keep-last and other reshaping of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborlake.runtime import require_columns


def insert_origin(df: DataFrame, after: str, origin: str, fill: str = "") -> DataFrame:
    """PR-04: origin moved right behind a column, null text filled."""
    require_columns(df, (after, origin))
    order = [c for c in df.columns if c != origin]
    order.insert(order.index(after) + 1, origin)
    text = {c for c, t in df.dtypes if t == "string"}
    return df.select(*[F.coalesce(c, F.lit(fill)).alias(c) if c in text else F.col(c) for c in order])


def keep_last(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row per key, the last by order (later order columns break ties); keys may be null.

    Aggregates before the shuffle, so a key with any number of rows is no single task's burden.
    """
    rest = [c for c in df.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(last.alias("_x")).select(*[F.col(k) for k in keys], *[F.col("_x")[c].alias(c) for c in rest]).select(*df.columns)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """IO-11: new rows replace old ones of the same key. Within one batch rows of a key should be
    equal; otherwise the greatest wins. Columns of either side that the other lacks become null."""
    both = old.withColumn("_seq", F.lit(0)).unionByName(new.withColumn("_seq", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in both.columns if c not in keys and c != "_seq"]
    return keep_last(both, keys, F.col("_seq"), *[F.col(c) for c in rest]).drop("_seq")


def ranked(df: DataFrame, by: list[str], *order: Column, name: str = "rank") -> DataFrame:
    """Row number within groups, from 1."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
