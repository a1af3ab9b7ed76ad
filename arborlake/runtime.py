"""Session defaults, staged tables in shared storage, schema helpers and skew-proof joins."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: A join key is hot when it holds more rows than this, and more than 1/500 of its table.
HOT_MIN_ROWS = 200_000
HOT_FRACTION = 500
#: Rows a table may have to be broadcast by bounded(): some megabytes, whatever the data.
BROADCAST_ROWS = 4_000


def session(app: str = "arborlake", cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """A local session with the defaults the tests and the bench use."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def is_local(spark: SparkSession) -> bool:
    """Whether driver and executors are one process on one machine."""
    return spark.sparkContext.master.split("[")[0] == "local"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset, a temporary one in
    local mode only; a cluster's executors would not see it, so that is an error."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not set_dir:
        if not is_local(spark):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        set_dir = tempfile.mkdtemp(prefix="arborlake-")
        spark.sparkContext.setCheckpointDir(set_dir)
    return set_dir


class Stage:
    """Tables written to shared storage to cut lineage in iterative operators.

    ``save`` writes a DataFrame as parquet and returns the table read back, so a lost executor
    costs a re-read and never a re-run of the iterations. ``observe`` metrics come out of the same
    write. Superseded tables are dropped with ``drop``; what is left goes when the driver exits.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self._n = 0
        self._paths: dict[int, str] = {}
        atexit.register(self._clean)

    def save(self, df: DataFrame, metrics: Mapping[str, Column] | None = None):
        """Write and read back; with metrics returns (table, {metric: value})."""
        self._n += 1
        path = f"{self.base}/{self._n}"
        seen = Observation() if metrics else None
        out = df.observe(seen, *[c.alias(k) for k, c in metrics.items()]) if metrics else df
        out.write.parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(table)] = path
        table._arborlake_path = path  # keeps the id stable while the table is referenced
        return (table, seen.get) if metrics else table

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            if path := getattr(t, "_arborlake_path", None):
                self._delete(path)

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def _clean(self) -> None:
        try:
            self._delete(self.base)
        except Exception:  # the session is gone already
            pass


def require_columns(df: DataFrame, cols: Iterable[str], context: str = "") -> DataFrame:
    """Raise ValueError naming every missing column."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"{context or 'input'} lacks columns: {', '.join(missing)}")
    return df


def resolve_column(df: DataFrame, candidates: Iterable[str]) -> str:
    """The first of several accepted spellings that the table has."""
    for c in candidates:
        if c in df.columns:
            return c
    raise ValueError(f"none of {list(candidates)} in {df.columns}")


def hot_keys(counts: DataFrame, key: str, n: str, total: int, least: int = HOT_MIN_ROWS) -> dict:
    """{key: number of salts} of the keys that hold too many rows for one task.

    counts has one row per key. A hot key has over max(least, total/500) rows, so there are fewer
    than 500 of them whatever the data: the list is small enough to collect and to broadcast.
    """
    limit = max(least, total // HOT_FRACTION)
    if total <= limit:
        return {}
    return {r[0]: int(r[1] // limit) + 1 for r in counts.filter(F.col(n) > limit).select(key, n).collect()}


def find_hot(df: DataFrame, key: str) -> dict:
    """hot_keys of a table's key column, by one pre-aggregating count; nothing is hot in small tables."""
    counts = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_c"))
    total, most = counts.agg(F.sum("_c"), F.max("_c")).first()
    return hot_keys(counts, key, "_c", total) if (most or 0) > HOT_MIN_ROWS else {}


def skew_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, hot: dict, salt_on: str, how: str = "inner", right_rows: int | None = None) -> DataFrame:
    """left joined to right (unique by right_key); rows of hot keys are spread over salts.

    Plain equi-join when nothing is hot. Otherwise left rows of a hot key take a salt from the hash
    of salt_on and the matching right row is repeated once per salt (at most 500 keys). right_rows,
    where it is known, decides whether right is broadcast (bounded()).
    """
    small = right_rows is not None and right_rows <= BROADCAST_ROWS
    if right_rows is not None and (small or not hot):
        right = bounded(right, right_rows)
    if not hot or small:
        return left.join(right, F.col(left_key) == F.col(right_key), how)
    spark = left.sparkSession
    table = F.broadcast(spark.createDataFrame([(k, v) for k, v in hot.items()], "_hk string, _hn int"))
    salted = left.join(table, F.col(left_key) == F.col("_hk"), "left").withColumn(
        "_salt", F.coalesce(F.pmod(F.xxhash64(salt_on), F.col("_hn")).cast("int"), F.lit(0))
    ).drop("_hk", "_hn")
    spread = right.join(table, F.col(right_key) == F.col("_hk"), "left").withColumn(
        "_salt_r", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_hn") - 1, F.lit(0))))
    ).drop("_hk", "_hn")
    return salted.join(spread, (F.col(left_key) == F.col(right_key)) & (F.col("_salt") == F.col("_salt_r")), how).drop("_salt", "_salt_r")


def lookup(left: DataFrame, right: DataFrame, left_key: str, right_key: str, salt_on: str, how: str = "inner") -> DataFrame:
    """left joined to right, unique by right_key, on a key that may be hot: salted where it is. Keys of
    any type; hot ones are compared by their text."""
    kind = left.schema[left_key].dataType.simpleString()
    if kind == "string":
        return skew_join(left, right, left_key, right_key, find_hot(left, left_key), salt_on, how)
    a, b = left.withColumn("_lk", F.col(left_key).cast("string")), right.withColumn("_rk", F.col(right_key).cast("string"))
    return skew_join(a, b, "_lk", "_rk", find_hot(a, "_lk"), salt_on, how).drop("_lk", "_rk")


def bounded(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df, known to have so many rows, as a join side: broadcast up to the limit, merged beyond it, so
    that what is broadcast does not grow with the data."""
    return F.broadcast(df) if rows <= limit else df.hint("merge")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df over three tasks a core at least, for work that is heavy per row and small in bytes: sizes
    alone would put such rows into a few partitions."""
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)
    return df.repartition(n, *keys)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
