"""Parent-child rows to full hierarchies: root, depth, path, subtree size, descendants, circles.

Method: bottom-up leaf peeling. Each round takes the nodes without unpeeled children off the
active set and sends their subtree sizes to their parents; the reverse order of peeling then hands
root, depth and path down. What is left when a round takes off little (circles and tall trees) is the
residual core. Its nodes keep one pointer each, to the ancestor 2^k links up, with the smallest id
and the subtree size met on the way: rows of constant size, and a chain of length d costs log2(d)
rounds. Nodes whose pointer never leaves the core lie on circles or below them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlake.runtime import Stage, hot_keys, require_columns, skew_join


def newest_links(*tables: DataFrame, child: str = "child_id", parent: str = "parent_id", order: str = "loaded_at") -> DataFrame:
    """One (node, parent) row per distinct child of the tables together: the newest row's parent.

    Rows without a child are no links and drop out. An empty parent counts as none. Equal times:
    the larger parent id counts (copies therefore change nothing). Extra columns are ignored.
    """
    picked = None
    for t in tables:
        require_columns(t, (child, parent, order), "parent links")
        t = t.select(F.col(child).alias("node"), F.nullif(F.col(parent), F.lit("")).alias("parent"), F.col(order).alias("at"))
        picked = t if picked is None else picked.unionByName(t)
    return picked.filter("node is not null").groupBy("node").agg(F.max_by("parent", F.struct("at", "parent")).alias("parent"))


#: A round of peeling must take off this share of what is left; so all rounds together cost a multiple
#: of the first, and tall trees go to the core, where a round doubles what is known.
LEAST_PEELED = 1 / 8


def hierarchy(links: DataFrame, with_paths: bool = True, max_peels: int | None = None, least_peeled: float = LEAST_PEELED) -> DataFrame:
    """Full hierarchy of (node, parent) rows, one row per node.

    links: node (unique, non-null), parent (null for a root). Parents without a row of their own
    become roots with implicit = true.

    Returns node, parent, root, depth, subtree_size, on_cycle, peel, implicit and, with_paths, path
    (array root..node) and trunk. A node on a circle or below one has depth -1, the circle's smallest
    id as root and a null path; on_cycle tells the two apart. trunk is the path, below a circle the
    part of it that is off the circle, and empty on one. subtree_size counts the node itself and is
    null on circles only. peel is the round a node left in, null for the residual core.

    Peeling goes on while a round takes off least_peeled of the nodes left (0: to the end), for
    max_peels rounds at most; the core left over is resolved by pointer doubling, with the same
    result in all columns but peel. A parent with any number of
    children is fine: child statistics pre-aggregate, and joins on hot parents are salted. An empty
    table gives an empty one.
    """
    spark = links.sparkSession
    stage = Stage(spark, "hierarchy")
    base = links.select("node", "parent")
    implicit = (
        base.filter("parent is not null").select(F.col("parent").alias("node")).distinct()
        .join(base.select("node"), "node", "left_anti")
        .select("node", F.lit(None).cast("string").alias("parent"), F.lit(True).alias("implicit"))
    )
    nodes = base.withColumn("implicit", F.lit(False)).unionByName(implicit)
    # first round: who has children at all
    kids = base.filter("parent is not null").groupBy(F.col("parent").alias("_p")).agg(F.count("*").alias("_n"))
    start = nodes.join(kids, F.col("node") == F.col("_p"), "left").select(
        "node", "parent", "implicit", F.lit(1).cast("long").alias("size"), F.col("_p").isNull().alias("leaf"), F.col("_n").alias("kids")
    )
    active, seen = stage.save(start, {"n": F.count(F.lit(1)), "leaves": F.count_if("leaf")})
    hot = hot_keys(active.filter("kids is not null").select("node", "kids"), "node", "kids", seen["n"] or 0)

    layers: list[DataFrame] = []
    while seen["leaves"] and seen["leaves"] >= least_peeled * seen["n"] and (max_peels is None or len(layers) < max_peels):
        layers.append(active)  # its leaves are this round's layer
        stats = active.filter("parent is not null").groupBy(F.col("parent").alias("_p")).agg(
            F.count_if(~F.col("leaf")).alias("_open"), F.sum(F.when(F.col("leaf"), F.col("size"))).alias("_add")
        )
        rest = active.filter(~F.col("leaf")).join(stats, F.col("node") == F.col("_p"), "left").select(
            "node", "parent", "implicit", (F.col("size") + F.coalesce("_add", F.lit(0))).alias("size"), (F.coalesce("_open", F.lit(0)) == 0).alias("leaf"), "kids"
        )
        active, seen = stage.save(rest, {"n": F.count(F.lit(1)), "leaves": F.count_if("leaf")})

    solved = _core(stage, active, seen["n"], with_paths)
    cols = ["node", "parent", "implicit", "root", "depth", "on_cycle", "size", "peel"] + (["trunk"] if with_paths else [])
    solved = solved.select(*cols)
    for k in range(len(layers) - 1, -1, -1):
        up = solved.select(F.col("node").alias("_u"), F.col("root").alias("_r"), F.col("depth").alias("_d"), *([F.col("trunk").alias("_trunk")] if with_paths else []))
        layer = layers[k].filter("leaf").drop("leaf", "kids")
        grown = skew_join(layer, up, "parent", "_u", hot, "node", "left")
        below = F.col("_d") == -1
        new = grown.select(
            "node", "parent", "implicit",
            F.coalesce("_r", "node").alias("root"),
            F.when(F.col("_u").isNull(), 0).when(below, -1).otherwise(F.col("_d") + 1).cast("int").alias("depth"),
            F.lit(False).alias("on_cycle"), "size", F.lit(k).alias("peel"),
            *([F.when(F.col("_u").isNull(), F.array("node")).otherwise(F.concat("_trunk", F.array("node"))).alias("trunk")] if with_paths else []),
        )
        if k:
            new = stage.save(new)
        solved = solved.unionByName(new)
    if with_paths:
        solved = solved.withColumn("path", F.when(F.col("depth") >= 0, F.col("trunk")))
    return solved.withColumnRenamed("size", "subtree_size")


def _core(stage: Stage, active: DataFrame, n: int, with_paths: bool) -> DataFrame:
    """Root, depth, trunk and subtree size of the residual core by pointer doubling.

    After k rounds a node's up is its ancestor 2^k links above (null past a root), top the highest
    ancestor met, dist the links to it, low the smallest id of the node and those below up, and size
    the sum over its descendants nearer than 2^k. A rooted node still open has an ancestor that the
    next round closes; so when a round closes none, the open nodes hang on circles, and once 2^k
    reaches their number every up is on its circle and low has seen all of it.
    """
    start = active.select(
        "node", "parent", "implicit", "size", F.col("parent").alias("up"), F.coalesce("parent", "node").alias("top"),
        F.col("parent").isNotNull().cast("int").alias("dist"), F.col("node").alias("low"),
    )
    cols = ["node", "parent", "implicit", "size", "root", "depth", "on_cycle", "peel", "trunk"]
    if not n:
        empty = start.withColumns({"root": F.col("top"), "depth": F.col("dist"), "on_cycle": F.lit(False), "peel": F.lit(None).cast("int"), "trunk": F.array("node")})
        return empty.select(*cols)
    is_open = {"open": F.count_if(F.col("up").isNotNull())}
    state, seen = stage.save(start, is_open)
    open_, width, closing = seen["open"], 1, True

    def below(t: DataFrame) -> tuple[DataFrame, dict]:
        counts = t.filter("up is not null").groupBy(F.col("up").alias("_a")).agg(F.sum("size").alias("_s"), F.count("*").alias("_n"))
        return counts, hot_keys(counts, "_a", "_n", open_)

    while open_ and (closing or width < open_):
        sums, hot = below(state)
        ahead = state.select(F.col("node").alias("_o"), F.col("up").alias("_up"), F.col("top").alias("_top"), F.col("dist").alias("_dist"), F.col("low").alias("_low"))
        grown = state.join(sums, F.col("node") == F.col("_a"), "left").withColumn("size", F.col("size") + F.coalesce("_s", F.lit(0))).drop("_a", "_s", "_n")
        step = skew_join(grown, ahead, "up", "_o", hot, "node", "left").select(
            "node", "parent", "implicit", "size", F.col("_up").alias("up"), F.coalesce("_top", "top").alias("top"),
            (F.col("dist") + F.coalesce("_dist", F.lit(0))).alias("dist"), F.least("low", "_low").alias("low"),
        )
        before = state
        state, seen = stage.save(step, is_open)
        stage.drop(before)
        closing, open_, width = seen["open"] < open_, seen["open"], 2 * width

    sums, hot = below(state)
    on = sums.select(F.col("_a").alias("_c"))
    circle = state.select(F.col("node").alias("_o"), F.col("low").alias("_low"))
    marked = skew_join(state, circle, "up", "_o", hot, "node", "left").join(on, F.col("node") == F.col("_c"), "left")
    hung, round_ = F.col("up").isNotNull(), F.col("_c").isNotNull()
    found = marked.select(
        "node", "parent", "implicit", F.when(~round_, F.col("size")).alias("size"),
        F.when(hung, F.col("_low")).otherwise(F.col("top")).alias("root"), F.when(hung, -1).otherwise(F.col("dist")).cast("int").alias("depth"),
        round_.alias("on_cycle"), F.lit(None).cast("int").alias("peel"),
    )
    found, _ = stage.save(found, {"n": F.count(F.lit(1))})
    if not with_paths:
        return found.withColumn("trunk", F.array("node")).select(*cols)
    return found.join(_trunks(stage, found), F.col("node") == F.col("_t"), "left").withColumn("trunk", F.coalesce("trunk", F.array().cast("array<string>"))).select(*cols)


def _trunks(stage: Stage, found: DataFrame) -> DataFrame:
    """(_t, trunk) of the nodes off circles: segments of the path, doubled until they end. The rows
    are as long as the paths that come out; circles, which would go round, have no part in it."""
    off = found.filter("not on_cycle").select(F.col("node").alias("_t"), F.col("parent").alias("_p"))
    inner = off.select(F.col("_t").alias("_q"))
    start = off.join(inner, F.col("_p") == F.col("_q"), "left").select("_t", F.col("_q").alias("_up"), F.array("_t").alias("trunk"))
    is_open = {"open": F.count_if(F.col("_up").isNotNull())}
    state, seen = stage.save(start, is_open)
    while seen["open"]:
        opened = state.filter("_up is not null")
        counts = opened.groupBy("_up").agg(F.count("*").alias("_n"))
        ahead = state.select(F.col("_t").alias("_o"), F.col("_up").alias("_next"), F.col("trunk").alias("_above"))
        step = skew_join(opened, ahead, "_up", "_o", hot_keys(counts, "_up", "_n", seen["open"]), "_t").select("_t", F.col("_next").alias("_up"), F.concat("_above", "trunk").alias("trunk"))
        before = state
        state, seen = stage.save(state.filter("_up is null").unionByName(step), is_open)
        stage.drop(before)
    return state.select("_t", "trunk")


def descendants(tree: DataFrame, below_circles: bool = False) -> DataFrame:
    """(ancestor, node, distance) rows of every node below every other: the descendant lists, one
    row per entry so that a root over a third of all nodes is no single huge row.

    tree: node, path and trunk of hierarchy(). Nodes on or below circles have no path and no rows; with
    below_circles, nodes below a circle are ancestors as well (those on one, each below all others,
    still are not).
    """
    path = "trunk" if below_circles else "path"
    return (
        tree.filter(F.col(path).isNotNull()).select("node", F.size(path).alias("_n"), F.posexplode(F.slice(path, 1, F.greatest(F.size(path) - 1, F.lit(0)))).alias("pos", "ancestor"))
        .select("ancestor", "node", (F.col("_n") - 1 - F.col("pos")).alias("distance"))
    )
