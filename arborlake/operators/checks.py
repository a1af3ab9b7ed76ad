"""Structure checks over a tree and its node table (tree_table): each returns the offending rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlake.functions.text import level_number
from arborlake.operators.hierarchy import hierarchy


def duplicate_ids(tree: DataFrame) -> DataFrame:
    """CK-01."""
    return tree.groupBy("node_id").agg(F.count("*").alias("n")).filter("n > 1")


def multiple_parents(links: DataFrame, child: str = "child_id", parent: str = "parent_id") -> DataFrame:
    """CK-02: children with several distinct non-null parents."""
    return links.groupBy(child).agg(F.count_distinct(parent).alias("n")).filter("n > 1")


def circles(links: DataFrame) -> DataFrame:
    """CK-03: nodes on a circle with the circle's smallest id; links: node, parent."""
    return hierarchy(links, with_paths=False).filter("on_cycle").select("node", F.col("root").alias("circle"))


def empty_labels(tree: DataFrame) -> DataFrame:
    """CK-04."""
    return tree.filter("level <> 'ROOT'").filter(F.trim(F.coalesce("label", F.lit(""))) == "").select("node_id")


def orphans(tree: DataFrame, root: str = "ROOT") -> DataFrame:
    """CK-05: nodes other than the root without a parent, or under one that does not exist."""
    known = tree.select(F.col("node_id").alias("parent_id")).distinct()
    return tree.filter(F.col("node_id") != root).join(known, "parent_id", "left_anti").select("node_id")


def level_depth_mismatch(table: DataFrame) -> DataFrame:
    """CK-06: nodes whose level text does not say their depth; unknown levels are not judged."""
    n = level_number(F.col("level"))
    return table.filter((n != 99) & (n != F.col("depth"))).select("node_id", "level", "depth")


def oversized(table: DataFrame, limit: int = 8) -> DataFrame:
    """CK-07."""
    return table.filter(F.col("children_count") > limit).select("node_id", "children_count")


def long_labels(table: DataFrame, limit: int = 25) -> DataFrame:
    """CK-08."""
    return table.filter(F.col("label_len") > limit).select("node_id", "label_len")


def sibling_duplicates(tree: DataFrame) -> DataFrame:
    """CK-09: (parent_id, label, n, first_id) of labels that siblings share; the ids themselves are
    a semi-join away, so that no group of copies becomes one row."""
    g = tree.filter("parent_id is not null and coalesce(label, '') <> ''").groupBy("parent_id", "label").agg(F.count("*").alias("n"), F.min("node_id").alias("first_id"))
    return g.filter("n > 1")


def equals_parent_label(table: DataFrame) -> DataFrame:
    """CK-10."""
    return table.filter("label <> '' and label = parent_label").select("node_id")


def cross_branch_labels(table: DataFrame) -> DataFrame:
    """CK-11: labels that occur under different parent labels."""
    g = table.filter("label <> '' and parent_label is not null").groupBy("label").agg(F.count_distinct("parent_label").alias("n_parents"), F.count("*").alias("n"))
    return g.filter("n_parents > 1")


def examples(rows: DataFrame, *order, k: int = 20) -> DataFrame:
    """CK-12: the first k rows of a check: a report's limit."""
    return rows.orderBy(*order).limit(k)


def report(tree: DataFrame, table: DataFrame) -> DataFrame:
    """RP-05: (section, metric, value) of all checks and sizes."""
    def one(section, metric, df):
        return df.agg(F.count("*").cast("double").alias("value")).select(F.lit(section).alias("section"), F.lit(metric).alias("metric"), "value")

    size = table.agg(
        F.count("*").alias("nodes"), F.count_if(F.col("parent_id").isNotNull()).alias("edges"), F.count_if("is_leaf").alias("leaves"), F.max("depth").alias("max_depth"),
        F.bround(F.avg(F.when(F.col("children_count") > 0, F.col("children_count"))), 2).alias("mean_children"),
    )
    names = ["nodes", "edges", "leaves", "max_depth", "mean_children"]
    stats = size.select(F.explode(F.array(*[F.struct(F.lit("size").alias("section"), F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])).alias("x")).select("x.*")
    parts = [
        one("issue", "duplicate_ids", duplicate_ids(tree)), one("issue", "empty_labels", empty_labels(tree)), one("issue", "orphans", orphans(tree)), one("issue", "level_depth_mismatch", level_depth_mismatch(table)),
        one("warning", "oversized", oversized(table)), one("warning", "long_labels", long_labels(table)), one("warning", "sibling_duplicates", sibling_duplicates(tree)),
        one("warning", "equals_parent_label", equals_parent_label(table)), one("warning", "cross_branch_labels", cross_branch_labels(table)),
    ]
    for p in parts:
        stats = stats.unionByName(p)
    return stats
