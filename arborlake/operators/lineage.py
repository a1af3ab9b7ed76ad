"""Redirects to their end, operation logs to redirects, and lineage of samples through edits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlake.runtime import Stage, hot_keys, lookup, skew_join


def chase(redirects: DataFrame, max_rounds: int = 64) -> DataFrame:
    """TR-20, TR-18: (src, dst) with dst the last target of the chain, by pointer doubling.

    redirects: src unique. A source that ends in a circle redirects to nothing and drops out; self
    redirects are no redirects. Rounds grow with the logarithm of the longest chain.
    """
    stage = Stage(redirects.sparkSession, "chase")
    start = redirects.filter("src is not null and dst is not null and src <> dst").select("src", "dst", F.lit(False).alias("done"))
    hops, seen = stage.save(start, {"n": F.count(F.lit(1))})
    total = seen["n"] or 0
    limit = min(max_rounds, max(2, total).bit_length() + 1)  # a longer chain than there are sources is a circle
    for _ in range(limit):
        nxt = hops.select(F.col("src").alias("_s"), F.col("dst").alias("_d"))
        hot = hot_keys(hops.groupBy("dst").agg(F.count("*").alias("n")), "dst", "n", total)
        jumped = skew_join(hops, nxt, "dst", "_s", hot, "src", "left").select("src", F.coalesce("_d", "dst").alias("dst"), F.col("_s").isNull().alias("done"))
        before = hops
        hops, seen = stage.save(jumped, {"open": F.count_if(~F.col("done"))})
        stage.drop(before)
        if not seen["open"]:
            break
    return hops.filter("done").select("src", "dst")


def merge_redirects(*maps: DataFrame) -> DataFrame:
    """TR-18: several redirect tables as one, later ones first where a source repeats, chased."""
    whole = None
    for i, m in enumerate(maps):
        m = m.select("src", "dst", F.lit(i).alias("_i"))
        whole = m if whole is None else whole.unionByName(m)
    return chase(whole.groupBy("src").agg(F.max_by("dst", F.struct("_i", "dst")).alias("dst")))


def log_redirects(ops: DataFrame) -> DataFrame:
    """TR-28: redirects of an operation log (seq, op, winner, loser, parent, child). merge and
    cross_merge name loser and winner; absorb_child sends the child to the parent. A source that
    occurs again takes its last operation."""
    src = F.when(F.col("op").isin("merge", "cross_merge"), F.col("loser")).when(F.col("op") == "absorb_child", F.col("child"))
    dst = F.when(F.col("op").isin("merge", "cross_merge"), F.col("winner")).when(F.col("op") == "absorb_child", F.col("parent"))
    rows = ops.select("seq", src.alias("src"), dst.alias("dst")).filter("src is not null and dst is not null")
    return rows.groupBy("src").agg(F.max_by("dst", F.struct("seq", "dst")).alias("dst"))


def apply_redirects(df: DataFrame, redirects: DataFrame, column: str) -> DataFrame:
    """TR-19: column replaced by its chased target where it has one."""
    r = redirects.select(F.col("src").alias("_s"), F.col("dst").alias("_d"))
    salt_on = next((c for c in df.columns if c != column), column)
    return lookup(df, r, column, "_s", salt_on, "left").withColumn(column, F.coalesce("_d", column)).drop("_s", "_d")


def initial_nodes(*memberships: DataFrame) -> DataFrame:
    """JN-16: first node of every sample; the later table wins, equal ones by the smaller node."""
    whole = None
    for i, m in enumerate(memberships):
        m = m.select("member_id", "node_id", F.lit(-i).alias("_i"))
        whole = m if whole is None else whole.unionByName(m)
    return whole.groupBy("member_id").agg(F.min_by("node_id", F.struct("_i", "node_id")).alias("node_id"))


def lineage_report(samples: DataFrame, initial: DataFrame, redirects: DataFrame, tree: DataFrame) -> DataFrame:
    """TR-29: sample_id, initial_node_id, final_node_id, status: FILTERED_EARLY without a node, ACTIVE
    when the final node is in the tree, else ORPHAN."""
    joined = samples.join(initial.select(F.col("member_id").alias("sample_id"), F.col("node_id").alias("initial_node_id")), "sample_id", "left")
    final = apply_redirects(joined.withColumn("final_node_id", F.col("initial_node_id")), redirects, "final_node_id")
    out = final.join(tree.select(F.col("node_id").alias("_n")), F.col("final_node_id") == F.col("_n"), "left")
    status = F.when(F.col("initial_node_id").isNull(), "FILTERED_EARLY").when(F.col("_n").isNotNull(), "ACTIVE").otherwise("ORPHAN")
    return out.select("sample_id", "initial_node_id", "final_node_id", status.alias("status"))


def audit_operations(ops: DataFrame, table: DataFrame) -> DataFrame:
    """TR-21: status and message of rename, move and merge operations before they are applied.

    ops: seq, type, node_id, target; table: node_id, path_ids of tree_table. Refused are unknown
    types, unknown nodes or targets, the node itself, targets under another first-level node and
    targets below the node.
    """
    n = table.select(F.col("node_id").alias("_n"), F.try_element_at("path_ids", F.lit(2)).alias("_n1"))
    t = table.select(F.col("node_id").alias("_t"), F.try_element_at("path_ids", F.lit(2)).alias("_t1"), F.col("path_ids").alias("_tp"))
    j = ops.join(n, F.col("node_id") == F.col("_n"), "left").join(t, F.col("target") == F.col("_t"), "left")
    needs = F.col("type").isin("move", "merge")
    why = (
        F.when(~F.col("type").isin("rename", "move", "merge"), "unknown type").when(F.col("_n").isNull(), "unknown node").when(needs & F.col("_t").isNull(), "unknown target")
        .when(needs & (F.col("node_id") == F.col("target")), "same node").when(needs & ~F.col("_n1").eqNullSafe(F.col("_t1")), "other branch").when(needs & F.array_contains("_tp", F.col("node_id")), "below itself")
    )
    return j.select("seq", "type", "node_id", "target", F.when(why.isNull(), "applied").otherwise("skipped").alias("status"), F.coalesce(why, F.lit("ok")).alias("message"))


_LOG = "seq long, type string, node_id string, target string, label string, status string, message string"


def apply_operations(tree: DataFrame, table: DataFrame, ops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """TR-21: (tree, log) after audit operations were applied one after the other, in order of seq.

    ops: seq, type, node_id, target, label; table: node_id, path_ids of tree_table. An operation sees
    what earlier ones of its branch (first-level node) left; other branches are out of its reach, so
    branches are independent and each is one task over the paths of the nodes its operations name.
    rename gives label, move a new parent; merge sends a node's children to target and removes it.
    Refused: unknown types, nodes or targets that are not there (any more), a rename without a label,
    the node itself, targets of another branch and targets below the node. log: ops with status
    (applied, skipped) and message; nothing is lost.
    """
    n = table.select(F.col("node_id").alias("_n"), F.col("path_ids").alias("_np"))
    t = table.select(F.col("node_id").alias("_t"), F.col("path_ids").alias("_tp"))
    o = ops.select(F.col("seq").cast("long").alias("seq"), "type", "node_id", "target", F.col("label").cast("string").alias("label"))
    j = lookup(lookup(o, n, "node_id", "_n", "seq", "left"), t, "target", "_t", "seq", "left")
    j = j.withColumn("_branch", F.coalesce(F.try_element_at("_np", F.lit(2)), F.lit("")))

    def run(x):
        import pandas as pd

        up: dict[str, str | None] = {}
        for col in ("_np", "_tp"):
            for path in x[col]:
                if path is not None:
                    up.update({b: a for a, b in zip([None, *path], path)})
        gone, out = set(), []

        def above(node) -> list[str]:
            line = []
            while node is not None:
                line.append(node)
                node = up.get(node)
            return line[::-1]

        for r in x.sort_values("seq", kind="stable").itertuples(index=False):
            kind, node, target, why = r.type, r.node_id, r.target, None
            if kind not in ("rename", "move", "merge"):
                why = "unknown type"
            elif node not in up or node in gone:
                why = "unknown node"
            elif kind == "rename":
                why = None if r.label else "no label"
            elif target not in up or target in gone:
                why = "unknown target"
            elif target == node:
                why = "same node"
            else:
                line = above(target)
                why = "other branch" if line[1:2] != above(node)[1:2] else "below itself" if node in line else None
                if why is None and kind == "move":
                    up[node] = target
                elif why is None:
                    gone.add(node)
                    up.update({c: target for c, p in up.items() if p == node and c != target})
            out.append((r.seq, kind, node, target, r.label, "skipped" if why else "applied", why or "ok"))
        return pd.DataFrame(out, columns=["seq", "type", "node_id", "target", "label", "status", "message"])

    spark = tree.sparkSession
    cols = ["seq", "type", "node_id", "target", "label", "_np", "_tp"]
    log = Stage(spark, "operations").save(j.groupBy("_branch").applyInPandas(lambda x: run(x[cols]), _LOG))
    done = log.filter("status = 'applied'")
    last = lambda kind, col: done.filter(F.col("type") == kind).groupBy(F.col("node_id").alias("_d")).agg(F.max_by(col, "seq").alias("_v"))
    named = tree.join(last("rename", "label"), F.col("node_id") == F.col("_d"), "left").withColumn("label", F.coalesce("_v", "label")).drop("_d", "_v")
    moved = named.join(last("move", "target"), F.col("node_id") == F.col("_d"), "left").withColumn("parent_id", F.coalesce("_v", "parent_id")).drop("_d", "_v")
    merged = done.filter("type = 'merge'").select(F.col("node_id").alias("src"), F.col("target").alias("dst"))
    kept = moved.join(merged.select(F.col("src").alias("node_id")), "node_id", "left_anti")
    return apply_redirects(kept, chase(merged), "parent_id").select(*tree.columns), log
