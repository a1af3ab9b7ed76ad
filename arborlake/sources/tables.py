"""Readers and writers: CSV with its null and BOM rules, pairs, vectors, JSON lines and nested trees."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlake.functions.text import safe_file_name  # noqa: F401  (IO-15)
from arborlake.runtime import require_columns

# Text that counts as missing where missing text is read as null.
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def read_csv(spark: SparkSession, path: str, missing_as_null: bool = True) -> DataFrame:
    """IO-01, IO-02, IO-03: all-text CSV with header and multi-line fields; a byte-order mark before the
    first header is dropped. missing_as_null turns the usual spellings of "missing" into null; without
    it "NA" stays as it is and empty fields are empty. Gzip is read by its suffix."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"', inferSchema=False, emptyValue="", nullValue="\x00", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    df = df.toDF(*[c.lstrip("\ufeff") for c in df.columns])
    if missing_as_null:
        return df.select(*[F.when(~F.col(f"`{c}`").isin(*MISSING), F.col(f"`{c}`")).alias(c) for c in df.columns])
    return df.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in df.columns])


def write_csv(df: DataFrame, path: str, gzip: bool = False) -> None:
    df.write.mode("overwrite").csv(path, header=True, escape='"', quoteAll=True, emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, compression="gzip" if gzip else "none")


def read_pairs(spark: SparkSession, path: str, only: Iterable[str] | None = None) -> DataFrame:
    """IO-04: scored pairs, plain or gzip; id_a, id_b and sim in any case; only narrows the columns."""
    df = read_csv(spark, path)
    names = {"id_a": "id_a", "id_b": "id_b", "sim": "sim"}
    df = df.toDF(*[names.get(c.strip().lower(), c) for c in df.columns])
    require_columns(df, ("id_a", "id_b"), "pairs")
    df = df.withColumn("sim", F.col("sim").try_cast("double")) if "sim" in df.columns else df
    return df.select(*only) if only else df


def read_vectors(df: DataFrame, key: str = "sample_id", dim_prefix: str = "dim_") -> DataFrame:
    """IO-05, IO-07: (key, vector) from any of three layouts: an array column, JSON text, or one column
    per dimension (dim_0, dim_1, ...). An array that is null falls back to the text."""
    types = dict(df.dtypes)
    v: list[Column] = []
    if types.get("vector", "").startswith("array"):
        v.append(F.col("vector").cast("array<float>"))
    if "embedding" in types:
        v.append(F.from_json("embedding", "array<float>"))
    dims = sorted((c for c in df.columns if c.startswith(dim_prefix) and c[len(dim_prefix) :].isdigit()), key=lambda c: int(c[len(dim_prefix) :]))
    if dims:
        v.append(F.array(*[F.col(c).cast("float") for c in dims]))
    if not v:
        raise ValueError("no vector columns")
    return df.select(key, F.coalesce(*v).alias("vector"))


def write_vectors(df: DataFrame, path: str) -> None:
    """IO-06."""
    df.write.mode("overwrite").parquet(path)


def tree_rows(tree: dict) -> list[tuple]:
    """IO-08: adjacency rows (node_id, label, level, parent_id, ord) of one nested tree document."""
    rows, todo = [], [(tree, None, 0)]
    while todo:
        node, parent, at = todo.pop()
        rows.append((str(node.get("node_id", "")).strip(), node.get("label"), node.get("level"), parent, at))
        todo += [(c, rows[-1][0], i) for i, c in enumerate(node.get("children") or [])]
    return rows


def nested_tree(rows: Iterable[tuple], root: str = "ROOT") -> dict:
    """IO-08: one tree document of adjacency rows; trees this size are edited by people."""
    nodes = {r[0]: {"node_id": r[0], "label": r[1], "level": r[2], "children": []} for r in rows}
    for r in sorted(rows, key=lambda r: (r[4], r[0])):
        if r[3] in nodes:
            nodes[r[3]]["children"].append(nodes[r[0]])
    return nodes[root]


_TREE = "node_id string, label string, level string, parent_id string, ord long"


def load_trees(spark: SparkSession, *paths: str) -> DataFrame:
    """IO-08: (file, adjacency rows) of nested tree documents, one a file, parsed where they are read;
    any number of files on any storage that Spark reads. A file that is no JSON object is an error."""
    files = spark.read.text(list(paths), wholetext=True).select(F.input_file_name().alias("file"), "value")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, text in zip(b.column("file").to_pylist(), b.column("value").to_pylist()):
                cols = list(zip(*tree_rows(json.loads(text.removeprefix("\ufeff")))))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(cols[0])), *[pa.array(c, pa.string()) for c in cols[:4]], pa.array(cols[4], pa.int64())], names=["file", "node_id", "label", "level", "parent_id", "ord"])

    return files.mapInArrow(parse, "file string, " + _TREE)


def load_tree(spark: SparkSession, path: str) -> DataFrame:
    """IO-08: adjacency rows of one nested tree document."""
    return load_trees(spark, path).drop("file")


def tree_documents(rows: DataFrame, by: str, root: str = "ROOT") -> DataFrame:
    """IO-08: (by, document) with one nested tree document per value of by; a document is one text, so
    its tree is the unit that must fit a task. rows: by, node_id, label, level, parent_id, ord."""
    kind = rows.schema[by].dataType.simpleString()

    def nest(t: pa.Table) -> pa.Table:
        cols = [t.column(c).to_pylist() for c in ("node_id", "label", "level", "parent_id", "ord")]
        return pa.table({by: t.column(by)[:1], "document": pa.array([json.dumps(nested_tree(list(zip(*cols)), root), ensure_ascii=False)])})

    return rows.select(by, "node_id", "label", "level", "parent_id", "ord").groupBy(by).applyInArrow(nest, f"{by} {kind}, document string")


def append_json_lines(df: DataFrame, path: str) -> None:
    """IO-09."""
    df.write.mode("append").json(path)


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """IO-10: JSON lines; lines that are no JSON objects are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def seed_samples(rows: DataFrame, k: int = 50, label: str = "l1", order: tuple[str, ...] = ("doc_id", "sample_id"), file: str | None = None) -> DataFrame:
    """IO-12: the first k seeds of every label (and file)."""
    from pyspark.sql import Window

    w = Window.partitionBy(*([file] if file else []), label).orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).drop("_r")


def raters_of(files: DataFrame, column: str = "file_name", kind: str = "node") -> DataFrame:
    """IO-13: rater keys in file names judge_{key}_{kind}_scores.*"""
    key = F.regexp_extract(column, rf"judge_(.+)_{kind}_scores\.", 1)
    return files.select(key.alias("judge_key")).filter("judge_key <> ''").distinct()


def rater_files(spark: SparkSession, folder: str, kind: str = "node") -> list[str]:
    """IO-13: rater keys of the files and folders judge_{key}_{kind}_scores.* of a folder, in order."""
    found = (re.search(rf"judge_(.+)_{kind}_scores\.", name) for name in list_names(spark, folder))
    return sorted({m[1] for m in found if m})


def _file_system(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def list_names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder of any storage that Spark reads."""
    fs, p = _file_system(spark, folder)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def first_existing(*paths: str, spark: SparkSession | None = None) -> str:
    """IO-14: the first path that exists, on any storage that Spark reads."""
    spark = spark or SparkSession.getActiveSession()
    for path in paths:
        if path:
            fs, p = _file_system(spark, path)
            if fs.exists(p):
                return path
    raise FileNotFoundError(f"none of {paths}")


class Catalog:
    """HP-11, HP-10: places of the stages' tables below one folder."""

    def __init__(self, base: str, spark: SparkSession | None = None):
        self.base = base.rstrip("/")
        self.spark = spark or SparkSession.getActiveSession()

    def nodes(self, level: str) -> str:
        return f"{self.base}/tree_nodes_{level}"

    def membership(self, level: str) -> str:
        return f"{self.base}/tree_node_membership_{level}"

    def links(self, child: str, parent: str) -> str:
        return f"{self.base}/tree_parent_links_{child}_to_{parent}"

    def edges(self, level: str) -> str:
        return f"{self.base}/cluster_edges_{level}"

    def trees(self, exclude: Iterable[str] = ("label_map",)) -> list[str]:
        found = sorted(f for f in list_names(self.spark, self.base) if f.endswith(".json") and not any(x in f for x in exclude))
        return [f"{self.base}/{f}" for f in found]
