"""Near-duplicate nodes by label overlap and vector cosine: quick check, siblings, across parents."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborlake.functions.text import jaccard, tokens
from arborlake.operators.ranking import full_rank, sliding_pairs
from arborlake.operators.similarity import cosine_unit, l2_normalize
from arborlake.runtime import Stage, find_hot, skew_join

#: Rows of one side of a matrix product within a group.
BLOCK_ROWS = 2_048


def quick_check(label_a: Column, label_b: Column, v_a: Column, v_b: Column, overlap: float, cosine: float) -> Column:
    """VC-15: token overlap of the labels or cosine (0..1) of the vectors at its threshold. Null or
    empty labels overlap with nothing, null or zero vectors have cosine 0."""
    return (jaccard(tokens(label_a), tokens(label_b)) >= overlap) | (cosine_unit(v_a, v_b) >= cosine)


def redundant_pair(label_a: Column, label_b: Column, v_a: Column, v_b: Column, overlap: float = 0.3, cosine: float = 0.5) -> Column:
    """VC-16: whether a parent-child pair is worth a decision: not when overlap and cosine are both
    below their thresholds."""
    return ~((jaccard(tokens(label_a), tokens(label_b)) < overlap) & (cosine_unit(v_a, v_b) < cosine))


def classes(nodes: DataFrame, group: str, key: str = "node_id", label: str = "label", vector: str = "v") -> DataFrame:
    """(id, class_id, group, tokens, v) of every node: nodes of one group with the same tokens and the
    same vector are one class, named by its smallest id. Null groups hold no siblings and drop out."""
    rows = nodes.filter(F.col(group).isNotNull()).select(F.col(key).alias("id"), F.col(group).cast("string").alias("group"), F.array_sort(F.array_distinct(tokens(F.col(label)))).alias("tokens"), F.col(vector).cast("array<double>").alias("v"))
    h = rows.withColumn("_h", F.xxhash64("group", "tokens", "v"))
    first = h.groupBy(F.col("_h").alias("_c")).agg(F.min("id").alias("class_id"))
    named = skew_join(h.withColumn("_h", F.col("_h").cast("string")), first.withColumn("_c", F.col("_c").cast("string")), "_h", "_c", find_hot(h.select(F.col("_h").cast("string").alias("_h")), "_h"), "id")
    return named.select("id", "class_id", "group", "tokens", "v")


def overlapping(items: DataFrame, threshold: float) -> DataFrame:
    """(id_a < id_b) of items (id, group, tokens) of one group with a token overlap of threshold or more.

    Prefix filter: two sets that similar share one of the rarest tokens of each and have similar
    sizes, so items meet only under (group, rare token, size); the rest is an exact test.
    """
    t = items.filter(F.size("tokens") > 0)
    spots = t.select("id", F.explode("tokens").alias("_t"))
    rarity = spots.groupBy(F.col("_t").alias("_k")).agg(F.count("*").alias("_n"))
    ranked = skew_join(spots, rarity, "_t", "_k", find_hot(spots, "_t"), "id").groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "_t"))), lambda x: x["_t"]).alias("_o"))
    size = F.size("tokens")
    keep = (size - F.ceil(size * threshold - 1e-9) + 1).cast("int")
    keyed = t.join(ranked, "id").select("id", "group", "tokens", size.alias("size"), F.explode(F.slice("_o", 1, keep)).alias("t"))
    small = keyed.select(F.col("id").alias("i"), F.col("tokens").alias("x"), "group", "t", "size")
    large = keyed.select(F.col("id").alias("j"), F.col("tokens").alias("y"), "group", "t", F.col("size").alias("_s")).withColumn("size", F.explode(F.sequence(F.ceil(F.col("_s") * threshold - 1e-9).cast("int"), F.col("_s"))))
    met = small.join(large, ["group", "t", "size"]).filter((F.col("i") != F.col("j")) & ((F.col("size") < F.col("_s")) | (F.col("i") < F.col("j"))))
    return met.filter(jaccard(F.col("x"), F.col("y")) >= threshold).select(F.least("i", "j").alias("id_a"), F.greatest("i", "j").alias("id_b")).distinct()


def close_vectors(items: DataFrame, threshold: float) -> DataFrame:
    """(id_a < id_b) of items (id, group, v) of one group with a cosine (0..1) of threshold or more.

    A group's rows are cut into blocks of BLOCK_ROWS and every two blocks meet in a task of their own,
    so a group of any size is spread; small groups share tasks. Only pairs at the threshold leave.
    """
    kind = items.schema["id"].dataType.simpleString()
    rows = items.filter("v is not null").select("id", "group", l2_normalize(F.col("v")).alias("v"))
    placed = full_rank(rows, "group", [F.asc("id")], "_r", total="_n")
    last = F.floor((F.col("_n") - 1) / BLOCK_ROWS)
    own = F.floor((F.col("_r") - 1) / BLOCK_ROWS)
    other = F.explode(F.sequence(F.lit(0).cast("long"), last))
    placed = placed.withColumn("_own", own).withColumn("_other", other)
    pair = F.struct(F.least("_own", "_other").alias("a"), F.greatest("_own", "_other").alias("b"))
    spread = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")) * 4
    task = F.when(F.col("_n") > BLOCK_ROWS, F.concat_ws("/", F.lit("g"), "group", F.col("_p.a"), F.col("_p.b"))).otherwise(F.concat(F.lit("h"), F.pmod(F.xxhash64("group"), F.lit(spread)).cast("string")))
    met = placed.withColumn("_p", pair).select("id", "group", "v", "_own", F.col("_p.a").alias("_a"), F.col("_p.b").alias("_b"), task.alias("_task"))

    def meet(t: pa.Table) -> pa.Table:
        t = t.sort_by("group")
        ids, sizes = t.column("id").combine_chunks(), pa.compute.list_value_length(t.column("v").combine_chunks()).to_numpy(zero_copy_only=False)
        flat = t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        groups = t.column("group").combine_chunks().dictionary_encode().indices.to_numpy()
        left, right = t.column("_own").to_numpy() == t.column("_a").to_numpy(), t.column("_own").to_numpy() == t.column("_b").to_numpy()
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for rows in np.split(np.arange(len(ids)), np.flatnonzero(np.diff(groups)) + 1):
            if not len(rows):
                continue
            dim = int(np.bincount(sizes[rows]).argmax())
            rows = rows[sizes[rows] == dim]
            x = np.stack([flat[starts[r] : starts[r] + dim] for r in rows]) if dim else np.zeros((len(rows), 0))
            one, two = np.flatnonzero(left[rows]), np.flatnonzero(right[rows])
            s = (np.clip(x[one] @ x[two].T, -1, 1) + 1) / 2
            zero = ~x.any(1)
            s[zero[one]] = 0
            s[:, zero[two]] = 0
            i, j = np.nonzero(s >= threshold - 1e-12)
            i, j = rows[one[i]], rows[two[j]]
            a.append(i)
            b.append(j)
        i, j = np.concatenate(a), np.concatenate(b)
        x, y = ids.take(pa.array(i)), ids.take(pa.array(j))
        out = pa.table({"id_a": x, "id_b": y})
        return out.filter(pa.compute.less(x, y))

    return met.groupBy("_task").applyInArrow(meet, f"id_a {kind}, id_b {kind}").distinct()


def sibling_duplicates(nodes: DataFrame, group: str = "parent_id", key: str = "node_id", label: str = "label", vector: str = "v", overlap: float = 0.75, cosine: float = 0.85) -> tuple[DataFrame, DataFrame]:
    """TR-17, JN-10: (pairs, members). pairs: id_a < id_b, by_overlap, by_cosine, between classes of
    siblings at one of the thresholds; members: id, class_id. Nodes of one class are duplicates by
    definition and are not expanded into pairs."""
    stage = Stage(nodes.sparkSession, "duplicates")
    members = stage.save(classes(nodes, group, key, label, vector))
    items = members.filter("id = class_id")
    both = overlapping(items, overlap).withColumn("o", F.lit(True)).withColumn("c", F.lit(False)).unionByName(close_vectors(items, cosine).withColumn("o", F.lit(False)).withColumn("c", F.lit(True)))
    pairs = both.groupBy("id_a", "id_b").agg(F.bool_or("o").alias("by_overlap"), F.bool_or("c").alias("by_cosine"))
    return pairs, members.select("id", "class_id")


def cross_parent_duplicates(nodes: DataFrame, order: list[Column], level: str = "level", parent: str = "parent_id", key: str = "node_id", label: str = "label", vector: str = "v", band: int = 49, overlap: float = 0.80, cosine: float = 0.90) -> DataFrame:
    """TR-17, JN-11: (id_a, id_b) of nodes of one level and of different parents that pass the quick
    check; every node meets the next band nodes of its level in order, as many rows at any size."""
    rows = nodes.withColumn("_x", F.struct(F.col(key).alias("id"), F.col(parent).alias("p"), F.col(label).alias("l"), F.col(vector).alias("v")))
    met = sliding_pairs(rows, [level], order, "_x", band).filter("id_a.p <> id_b.p")
    return met.filter(quick_check(F.col("id_a.l"), F.col("id_b.l"), F.col("id_a.v"), F.col("id_b.v"), overlap, cosine)).select(F.col("id_a.id").alias("id_a"), F.col("id_b.id").alias("id_b"))


def merge_duplicates(pairs: DataFrame, members: DataFrame, decisions: DataFrame | None = None) -> DataFrame:
    """(loser, winner) rows of merges: the nodes of a class, and of classes whose pair a decision
    merges (no decision table: all pairs), go into the smallest id of their component.
    decisions: id_a, id_b, merge; a pair without one stays apart."""
    from arborlake.operators.graph import components

    agreed = pairs.select("id_a", "id_b")
    if decisions is not None:
        yes = decisions.filter("merge").select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b")).distinct()
        agreed = agreed.join(yes, ["id_a", "id_b"], "left_semi")
    ids = members.select(F.col("class_id").alias("id")).distinct()
    found = components(ids, agreed.select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))).select(F.col("id").alias("_c"), "component")
    hot = find_hot(members.select(F.col("class_id").cast("string").alias("class_id")), "class_id")
    return skew_join(members, found, "class_id", "_c", hot, "id").filter("id <> component").select(F.col("id").alias("loser"), F.col("component").alias("winner"))
