"""Trees as adjacency relations: nodes(node_id, label, level, parent_id, ord).

Edits return a new relation and never leave a removed node behind. Depth, path and preorder come
from the hierarchy operator, so deep trees and circles are no special case.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arborlake.operators.hierarchy import descendants, hierarchy
from arborlake.runtime import Stage, find_hot, skew_join


def build_tree(nodes: DataFrame, links: DataFrame, root: str = "ROOT") -> DataFrame:
    """TR-01, JN-04: nodes with their parent from links; links to unknown ids are dropped, nodes
    without a link hang on the root, which is added. A child with several links keeps the first by
    ord. nodes: node_id, label, level; links: child_id, parent_id, ord."""
    known = nodes.select("node_id")
    ok = links.join(known.withColumnRenamed("node_id", "child_id"), "child_id", "left_semi").join(known.withColumnRenamed("node_id", "parent_id"), "parent_id", "left_semi")
    first = ok.groupBy("child_id").agg(F.min_by(F.struct("parent_id", "ord"), F.struct("ord", "parent_id")).alias("x"))
    placed = nodes.join(first, F.col("node_id") == F.col("child_id"), "left").select("node_id", "label", "level", F.coalesce("x.parent_id", F.lit(root)).alias("parent_id"), F.coalesce("x.ord", F.lit(0)).cast("long").alias("ord"))
    top = nodes.sparkSession.createDataFrame([(root, "", "ROOT", None, 0)], "node_id string, label string, level string, parent_id string, ord long")
    return placed.unionByName(top)


def add_samples(tree: DataFrame, membership: DataFrame) -> DataFrame:
    """TR-02: samples as nodes of level Sample under their node."""
    s = membership.join(tree.select("node_id"), "node_id", "left_semi").select(F.col("member_id").alias("node_id"), F.col("member_id").alias("label"), F.lit("Sample").alias("level"), F.col("node_id").alias("parent_id"), F.lit(0).cast("long").alias("ord"))
    return tree.unionByName(s)


def tree_paths(tree: DataFrame) -> DataFrame:
    """TR-16, TR-30: node_id, root, depth, path (ids root..node) of every node on a root."""
    h = hierarchy(tree.select(F.col("node_id").alias("node"), F.col("parent_id").alias("parent")))
    return h.filter("not implicit").select(F.col("node").alias("node_id"), "root", "depth", "path", "on_cycle", "subtree_size")


def tree_table(tree: DataFrame) -> DataFrame:
    """TR-30, TR-31: every node with depth, parent label and level, children and sibling counts,
    leaf flag, label length, path ids and labels.

    Path labels join each path position once and fold per node, so labels may hold any character.
    """
    p = tree_paths(tree)
    labels = tree.select(F.col("node_id").alias("_i"), F.col("label").alias("_l"))
    # every path holds the root, so path positions have hot ids as parents have
    spots = p.select("node_id", F.posexplode("path").alias("_pos", "_id"))
    spots = skew_join(spots, labels, "_id", "_i", find_hot(spots, "_id"), "node_id")
    names = spots.groupBy("node_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_pos", F.coalesce("_l", F.lit("")).alias("_l")))), lambda x: x["_l"]).alias("path_labels"))
    kids = tree.filter("parent_id is not null").groupBy(F.col("parent_id").alias("_p")).agg(F.count("*").alias("_n"))
    parents = tree.select(F.col("node_id").alias("_pid"), F.col("label").alias("parent_label"), F.col("level").alias("parent_level"))
    out = tree.join(p.drop("on_cycle", "subtree_size"), "node_id", "left").join(names, "node_id", "left")
    out = out.join(kids.select(F.col("_p").alias("_k"), F.col("_n").alias("_kn")), F.col("node_id") == F.col("_k"), "left")
    hot = find_hot(tree, "parent_id")
    out = skew_join(out, kids.select(F.col("_p").alias("_s"), F.col("_n").alias("_sn")), "parent_id", "_s", hot, "node_id", "left")
    out = skew_join(out, parents, "parent_id", "_pid", hot, "node_id", "left")
    n = F.coalesce("_kn", F.lit(0))
    return out.select(
        "node_id", "label", "level", "depth", "parent_id", "parent_label", "parent_level", n.alias("children_count"), F.coalesce(F.col("_sn") - 1, F.lit(0)).alias("sibling_count"),
        (n == 0).alias("is_leaf"), F.length(F.coalesce("label", F.lit(""))).alias("label_len"), F.col("path").alias("path_ids"), "path_labels", "ord",
    )


def leaf_paths(table: DataFrame, level: str | None = None) -> DataFrame:
    """TR-03: (leaf_id, path_ids, path_labels) joined by "/", below the root, of leaves or of one level."""
    rows = table.filter(F.col("is_leaf") if level is None else F.col("level") == level)
    below = lambda c: F.array_join(F.slice(c, 2, F.greatest(F.size(c) - 1, F.lit(1))), "/")
    return rows.filter(F.size("path_ids") > 1).select(F.col("node_id").alias("leaf_id"), below("path_ids").alias("path_ids"), below("path_labels").alias("path_labels"))


def path_columns(table: DataFrame, depth: int = 4) -> DataFrame:
    """TR-04, TR-24: fixed columns L1..Ln of ids and labels; deeper levels have no column, so the
    whole path rides along as an array."""
    cols = []
    for i in range(1, depth + 1):
        cols += [F.try_element_at("path_ids", F.lit(i + 1)).alias(f"L{i}_id"), F.try_element_at("path_labels", F.lit(i + 1)).alias(f"L{i}_label")]
    return table.select("node_id", *cols, "path_ids")


def _paths_with_node(tree: DataFrame) -> DataFrame:
    h = hierarchy(tree.select(F.col("node_id").alias("node"), F.col("parent_id").alias("parent")))
    return h.filter("not implicit")


def remove_subtrees(tree: DataFrame, tops: DataFrame) -> DataFrame:
    """TR-07: tree without the given nodes and their descendants."""
    below = descendants(_paths_with_node(tree)).join(tops.select(F.col("node_id").alias("ancestor")), "ancestor", "left_semi").select(F.col("node").alias("node_id"))
    gone = below.unionByName(tops.select("node_id")).distinct()
    return tree.join(gone, "node_id", "left_anti")


def move_nodes(tree: DataFrame, moves: DataFrame) -> DataFrame:
    """TR-06: new parents for nodes (node_id, new_parent_id). Moves to itself, to an unknown node or
    below itself are refused. The moves of one batch are judged against the tree as it was."""
    p = _paths_with_node(tree).select(F.col("node").alias("_t"), "path")
    ok = moves.filter("node_id <> new_parent_id").join(p, F.col("new_parent_id") == F.col("_t")).filter(~F.array_contains("path", F.col("node_id")))
    one = ok.groupBy("node_id").agg(F.min("new_parent_id").alias("_np"))
    return tree.join(one, "node_id", "left").withColumn("parent_id", F.coalesce("_np", "parent_id")).drop("_np")


def absorb(tree: DataFrame, merges: DataFrame) -> DataFrame:
    """TR-09: children of losers go to winners, losers go. merges: (loser, winner); chains of merges
    follow to the last winner, circles and unknown winners are refused."""
    ids = tree.select(F.col("node_id").alias("dst"))
    m = merges.filter("loser <> winner").groupBy(F.col("loser").alias("src")).agg(F.min("winner").alias("dst"))
    from arborlake.operators.lineage import chase

    final = chase(m).join(ids, "dst", "left_semi")
    kept = tree.join(final.select(F.col("src").alias("node_id")), "node_id", "left_anti")
    ends = final.select(F.col("src").alias("_s"), F.col("dst").alias("_d"))
    return skew_join(kept, ends, "parent_id", "_s", find_hot(kept, "parent_id"), "node_id", "left").withColumn("parent_id", F.when(F.col("_d").isNotNull() & (F.col("_d") != F.col("node_id")), F.col("_d")).otherwise(F.col("parent_id"))).drop("_s", "_d")


def promotable(tree: DataFrame) -> DataFrame:
    """TR-08: (child_id, parent_id, grandparent_id, ok): a child may take its parent's place when it is
    the only child, a grandparent exists, and a child below L2 does not land on the root."""
    from arborlake.functions.text import level_number

    kids = tree.filter("parent_id is not null").groupBy(F.col("parent_id").alias("_p")).agg(F.count("*").alias("_n"))
    t = tree.select("node_id", "level", "parent_id")
    j = t.filter("parent_id is not null").select(F.col("node_id").alias("child_id"), F.col("level").alias("cl"), F.col("parent_id").alias("pid"))
    j = j.join(t.select(F.col("node_id").alias("pid"), F.col("parent_id").alias("grandparent_id")), "pid").join(kids, F.col("pid") == F.col("_p"))
    j = j.join(t.select(F.col("node_id").alias("_g"), F.col("level").alias("gl")), F.col("grandparent_id") == F.col("_g"), "left")
    ok = (F.col("_n") == 1) & F.col("_g").isNotNull() & ~((level_number(F.col("gl")) == 0) & (level_number(F.col("cl")) > 2))
    return j.select("child_id", F.col("pid").alias("parent_id"), "grandparent_id", ok.alias("ok"))


def collapse(tree: DataFrame, decisions: DataFrame) -> DataFrame:
    """TR-11: vertical decisions on parent-child pairs: keep, rename (label), absorb (the child goes,
    its children move up) or promote (the child takes its parent's place, where that is allowed).

    decisions: child_id, action, label. Judged against the tree as it was, in the order rename, absorb,
    promote; a pair without a decision is kept, and so is one whose decision does not fit.
    """
    names = decisions.filter("action = 'rename' and coalesce(label, '') <> ''").groupBy(F.col("child_id").alias("_c")).agg(F.min("label").alias("_l"))
    named = tree.join(names, F.col("node_id") == F.col("_c"), "left").withColumn("label", F.coalesce("_l", "label")).drop("_c", "_l")
    up = tree.select(F.col("node_id").alias("loser"), F.col("parent_id").alias("winner")).filter("winner is not null")
    less = absorb(named, up.join(decisions.filter("action = 'absorb'").select(F.col("child_id").alias("loser")), "loser", "left_semi"))
    ok = promotable(less).filter("ok").join(decisions.filter("action = 'promote'").select("child_id"), "child_id", "left_semi")
    moved = move_nodes(less, ok.select(F.col("child_id").alias("node_id"), F.col("grandparent_id").alias("new_parent_id")))
    return moved.join(ok.select(F.col("parent_id").alias("node_id")).distinct(), "node_id", "left_anti")


def add_children(tree: DataFrame, new: DataFrame) -> DataFrame:
    """TR-10, TR-15: new nodes under existing parents; an id that is taken gets _2 (or _k) behind it.
    new: node_id, label, level, parent_id. Rows under unknown parents are refused."""
    ok = new.join(tree.select(F.col("node_id").alias("parent_id")), "parent_id", "left_semi").withColumn("_k", F.row_number().over(Window.partitionBy("node_id").orderBy("parent_id", "label")))
    taken = tree.select(F.col("node_id").alias("_t")).distinct()
    n = F.col("_k") + F.col("_t").isNotNull().cast("int")
    named = ok.join(taken, F.col("node_id") == F.col("_t"), "left").withColumn("node_id", F.when(n > 1, F.concat_ws("_", "node_id", n)).otherwise(F.col("node_id")))
    return tree.unionByName(named.select("node_id", "label", "level", "parent_id", F.lit(0).cast("long").alias("ord")))


def insert_bridges(tree: DataFrame, bridges: DataFrame) -> DataFrame:
    """TR-15: a bridge node between a parent and some of its children. bridges: parent_id, label,
    child_id rows; the bridge's id hashes parent and label, its level is the parent's next one."""
    from arborlake.functions.text import next_level

    b = bridges.withColumn("bridge_id", F.concat(F.col("parent_id"), F.lit("_BR_"), F.substring(F.md5(F.concat("parent_id", F.lit("_"), "label", F.lit("_BR"))), 1, 6)))
    ok = b.join(tree.select(F.col("node_id").alias("child_id"), F.col("parent_id").alias("_pp")), "child_id").filter(F.col("_pp") == F.col("parent_id"))
    one = ok.groupBy("child_id").agg(F.min("bridge_id").alias("_b"))
    used = ok.join(one.select(F.col("_b").alias("bridge_id")).distinct(), "bridge_id", "left_semi").select("bridge_id", "label", "parent_id").distinct()
    made = used.join(tree.select(F.col("node_id").alias("parent_id"), F.col("level").alias("_l")), "parent_id").select(F.col("bridge_id").alias("node_id"), "label", next_level(F.col("_l")).alias("level"), "parent_id", F.lit(0).cast("long").alias("ord"))
    moved = tree.join(one.select(F.col("child_id").alias("_c"), "_b"), F.col("node_id") == F.col("_c"), "left").withColumn("parent_id", F.coalesce("_b", "parent_id")).drop("_c", "_b")
    return moved.unionByName(made)


def level_jumps(tree: DataFrame) -> DataFrame:
    """TR-12: children more than one level below their parent; a root parent counts as none."""
    from arborlake.functions.text import level_number

    p = tree.filter("level <> 'ROOT'").select(F.col("node_id").alias("parent_id"), level_number(F.col("level")).alias("pl"))
    p = p.withColumnRenamed("parent_id", "_pid")
    joined = skew_join(tree, p, "parent_id", "_pid", find_hot(tree, "parent_id"), "node_id")
    return joined.filter(level_number(F.col("level")) - F.col("pl") > 1).select("node_id", "parent_id")


def fan_out(tree: DataFrame, limit: int = 7) -> DataFrame:
    """TR-13: parents with more children than the limit."""
    return tree.filter("parent_id is not null").groupBy("parent_id").agg(F.count("*").alias("n")).filter(F.col("n") > limit)


def flatten_depth(tree: DataFrame, max_depth: int = 4, max_children: int = 3, rounds: int = 10) -> DataFrame:
    """TR-14: inner nodes at max_depth or deeper with few children hand them to their grandparent and
    go, at every depth in one round, until none is left or the rounds are over.

    A round equals a pass over all nodes, parents before children: a node is judged before its own
    children go, and lifting never takes a node from max_depth or deeper to above it, so depths are
    needed once. Chains of nodes that go are chased to the nearest ancestor that stays.
    """
    from arborlake.operators.lineage import chase

    stage = Stage(tree.sparkSession, "flatten")
    p = hierarchy(tree.select(F.col("node_id").alias("node"), F.col("parent_id").alias("parent")), with_paths=False)
    deep = p.filter(F.col("depth") >= max_depth).select(F.col("node").alias("_n"))
    now = stage.save(tree.join(deep, F.col("node_id") == F.col("_n"), "left").withColumn("_deep", F.col("_n").isNotNull()).drop("_n"))
    for _ in range(rounds):
        kids = now.filter("parent_id is not null").groupBy(F.col("parent_id").alias("_p")).agg(F.count("*").alias("_k")).filter(F.col("_k") <= max_children)
        hit = now.filter("_deep").join(kids, F.col("node_id") == F.col("_p")).select(F.col("node_id").alias("src"), F.col("parent_id").alias("dst"))
        hit, seen = stage.save(hit, {"n": F.count(F.lit(1))})
        if not seen["n"]:
            break
        ends = chase(hit).withColumnRenamed("src", "_src")
        kept = now.join(hit.select(F.col("src").alias("node_id")), "node_id", "left_anti")
        moved = skew_join(kept, ends, "parent_id", "_src", find_hot(kept, "parent_id"), "node_id", "left").withColumn("parent_id", F.coalesce("dst", "parent_id"))
        before, now = now, stage.save(moved.select(*now.columns))
        stage.drop(before, hit)
    return now.drop("_deep")


def relevel(tree: DataFrame, root: str = "ROOT") -> DataFrame:
    """TR-23: level text from the depth below the root (ROOT, L1, L2, ...)."""
    p = _paths_with_node(tree).select(F.col("node").alias("node_id"), "depth")
    return tree.drop("level").join(p, "node_id", "left").withColumn("level", F.when(F.col("node_id") == root, "ROOT").otherwise(F.concat(F.lit("L"), F.col("depth").cast("string")))).drop("depth")


def level_ancestor(table: DataFrame, depth: int = 1) -> DataFrame:
    """TR-22: (node_id, ancestor_id) at a depth of the path; nodes above it have none."""
    return table.select("node_id", F.try_element_at("path_ids", F.lit(depth + 1)).alias("ancestor_id"))


def prune(tree: DataFrame, valid: DataFrame, by: str | None = None) -> DataFrame:
    """TR-32, TR-33: nodes that are valid or above a valid one, per unit when by is given. valid:
    node_id (and by). One upward closure for all units; unknown ids count for nothing."""
    p = _paths_with_node(tree).select(F.col("node").alias("node_id"), "path").filter("path is not null")
    keys = [by] if by else []
    up = valid.join(p, "node_id").select(*keys, F.explode("path").alias("node_id")).distinct()
    return up.join(tree, "node_id")


def leaf_weights(tree: DataFrame) -> DataFrame:
    """TR-34: number of leaves at or below every node."""
    leaves = tree.join(tree.filter("parent_id is not null").select(F.col("parent_id").alias("node_id")).distinct(), "node_id", "left_anti").select("node_id")
    p = _paths_with_node(tree).select(F.col("node").alias("node_id"), "path")
    return leaves.join(p, "node_id").select(F.explode("path").alias("node_id")).groupBy("node_id").agg(F.count("*").alias("weight"))


def radial_layout(tree: DataFrame, gap_degrees: float = 3.5) -> DataFrame:
    """TR-35: angle interval, angle, radius, x and y of every node on a single root.

    The circle below the root is shared by leaf weight, with gaps between first-level nodes; inner
    intervals are shared by the children in (ord, node_id) order. One step per depth.
    """
    import math

    stage = Stage(tree.sparkSession, "layout")
    w = leaf_weights(tree)
    p = _paths_with_node(tree).select(F.col("node").alias("node_id"), "depth")
    base = stage.save(tree.join(w, "node_id").join(p, "node_id"))
    order = Window.partitionBy("parent_id").orderBy("ord", "node_id")
    shared = base.withColumn("_before", F.coalesce(F.sum("weight").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_all", F.sum("weight").over(Window.partitionBy("parent_id"))).withColumn("_nth", F.row_number().over(order) - 1)
    deepest, n1 = base.agg(F.max("depth"), F.count_if(F.col("depth") == 1)).first()
    gap = math.radians(gap_degrees)
    free = 2 * math.pi - gap * (n1 or 0)
    done = shared.filter("depth = 0").withColumn("a0", F.lit(0.0)).withColumn("a1", F.lit(2 * math.pi)).withColumn("a", F.lit(0.0))
    cols = ["node_id", "depth", "weight", "a0", "a1", "a"]
    layer = shared.filter("depth = 1").withColumn("a0", -math.pi / 2 + F.col("_nth") * gap + free * F.col("_before") / F.col("_all")).withColumn("a1", F.col("a0") + free * F.col("weight") / F.col("_all")).withColumn("a", (F.col("a0") + F.col("a1")) / 2)
    out = [done.select(*cols)]
    for depth in range(1, (deepest or 0) + 1):
        if depth > 1:
            up = layer.select(F.col("node_id").alias("_u"), F.col("a0").alias("_a0"), F.col("a1").alias("_a1"))
            nxt = shared.filter(F.col("depth") == depth).join(up, F.col("parent_id") == F.col("_u"))
            span = F.col("_a1") - F.col("_a0")
            layer = nxt.withColumn("a0", F.col("_a0") + span * F.col("_before") / F.col("_all")).withColumn("a1", F.col("a0") + span * F.col("weight") / F.col("_all")).withColumn("a", (F.col("a0") + F.col("a1")) / 2)
        layer = stage.save(layer.select(*cols))
        out.append(layer)
    whole = out[0]
    for x in out[1:]:
        whole = whole.unionByName(x)
    # Radii of the first depths and the step beyond them.
    radii, step = [0.0, 1.8, 3.7, 5.6, 7.5, 9.3, 10.9], 1.45
    r = F.when(F.col("depth") < len(radii), F.element_at(F.lit(radii), F.least(F.col("depth") + 1, F.lit(len(radii))))).otherwise(radii[-1] + (F.col("depth") - len(radii) + 1) * step)
    return whole.withColumn("r", r).withColumn("x", F.col("r") * F.cos("a")).withColumn("y", F.col("r") * F.sin("a"))


def angle_gaps(layout: DataFrame) -> DataFrame:
    """WN-12: smaller distance to the neighbours' angles within a depth; pi for a node alone."""
    import math

    w = Window.partitionBy("depth").orderBy("a", "node_id")
    return layout.withColumn("min_gap", F.coalesce(F.least(F.abs(F.col("a") - F.lag("a").over(w)), F.abs(F.lead("a").over(w) - F.col("a"))), F.lit(math.pi)))


def render_lines(table: DataFrame) -> DataFrame:
    """TR-25: one line per node with its markers: SingleChild for an only child, Repetitive for a
    label that repeats its parent's (ratio over 0.6)."""
    from arborlake.functions.text import sequence_ratio

    ratio = sequence_ratio(F.lower(F.coalesce("parent_label", F.lit(""))), F.lower(F.coalesce("label", F.lit(""))))
    rep = F.when(F.coalesce("parent_label", F.lit("")) != "", F.col("_s"))
    marks = F.concat_ws(" ", F.when((F.col("sibling_count") == 0) & F.col("parent_id").isNotNull(), "SingleChild"), F.when(rep > 0.6, F.concat(F.lit("Repetitive("), F.floor(rep * 100).cast("string"), F.lit("%)"))))
    line = F.concat(F.lit("- ["), "level", F.lit("] "), F.array_join("path_labels", " > "), F.lit(" ("), "node_id", F.lit(")"))
    return table.withColumn("_s", ratio).select("node_id", F.when(marks != "", F.concat(line, F.lit(" << "), marks, F.lit(" >>"))).otherwise(line).alias("line"))


def line_batches(blocks: DataFrame, limit: int = 200, by: str = "l1", block: str = "block_id", size: str = "size") -> DataFrame:
    """TR-26: batch number of each block: blocks in order fill batches of at most limit lines; a
    larger block is a batch of its own. The greedy fold runs over a group's ordered sizes."""
    packed = blocks.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(block, F.col(size).cast("int").alias("n")))).alias("b"))
    start = F.struct(F.lit(0).alias("batch"), F.lit(0).alias("used"), F.array().cast("array<int>").alias("out"))

    def step(acc, x):
        fits = (acc["used"] + x["n"]) <= limit
        batch = F.when(fits | (acc["used"] == 0), acc["batch"]).otherwise(acc["batch"] + 1)
        used = F.when(fits, acc["used"] + x["n"]).otherwise(x["n"])
        return F.struct(batch.alias("batch"), used.alias("used"), F.concat(acc["out"], F.array(batch)).alias("out"))

    folded = packed.withColumn("o", F.aggregate("b", start, step)["out"])
    return folded.select(by, F.explode(F.arrays_zip(F.col("b"), F.col("o"))).alias("z")).select(by, F.col(f"z.b.{block}").alias(block), F.col("z.o").alias("batch"))


def preorder(table: DataFrame, tree: DataFrame) -> DataFrame:
    """TR-30: sortable preorder key of every node: the zero-filled sibling orders along its path."""
    order = tree.select(F.col("node_id").alias("_i"), F.concat(F.lpad(F.coalesce("ord", F.lit(0)).cast("string"), 12, "0"), F.lit(":"), F.col("node_id")).alias("_o"))
    spots = table.select("node_id", F.posexplode("path_ids").alias("_pos", "_id")).join(order, F.col("_id") == F.col("_i"))
    return spots.groupBy("node_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_o"))), lambda x: x["_o"]), "/").alias("preorder"))
