"""P5: pairwise matches consolidated into groups by deterministic Boruvka hooking.

Every component selects its smallest outgoing edge (smallest by the hash of the edge's ends, then by
the ends themselves, a total order that is the same on every run and keeps the hooking trees
shallow). The selected edges form trees, up to one pair per tree that chose the same edge, whose
smaller member becomes the root. Trees collapse by pointer doubling; edges take the roots as new
ends, inner edges go, repeated ones collapse, and the next round starts until no edge remains.
Components at least halve per round, so rounds grow with the logarithm of the largest group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlake.runtime import Stage, hot_keys, require_columns, skew_join


def linked_pairs(edges: DataFrame, threshold: float, id_a: str = "id_a", id_b: str = "id_b", score: str = "rerank_score") -> DataFrame:
    """Distinct undirected links (u < v) of rows whose score reaches the threshold.

    Null, NaN and negative scores are no scores; self pairs and rows without an id are no links;
    repeated and reversed rows count once.
    """
    require_columns(edges, (id_a, id_b, score), "edges")
    good = F.col(score).isNotNull() & ~F.isnan(score) & (F.col(score) >= 0) & (F.col(score) >= threshold)
    return (
        edges.filter(good & (F.col(id_a) != F.col(id_b)))
        .select(F.least(id_a, id_b).alias("u"), F.greatest(id_a, id_b).alias("v"))
        .filter("u is not null and v is not null").distinct()
    )


def _keyed(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("w", F.xxhash64("u", "v"))


def connected_groups(pairs: DataFrame) -> DataFrame:
    """(node, group_id) of every end of the distinct pairs (u, v); group_id is the smallest member.

    Pairs may form any graph: a hub that holds a third of all edges is salted in every join, and
    selections pre-aggregate. An empty table gives an empty one.
    """
    stage = Stage(pairs.sparkSession, "components")
    edges, seen = stage.save(_keyed(pairs), {"n": F.count(F.lit(1))})
    rounds: list[tuple[DataFrame, int]] = []
    while seen["n"]:
        total = seen["n"]
        edge = F.struct("w", "u", "v")
        ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("c"), edge.alias("e")), F.struct(F.col("v").alias("c"), edge.alias("e")))).alias("x"))
        chosen, picked = stage.save(
            ends.groupBy("x.c").agg(F.min("x.e").alias("e"), F.count("*").alias("n")).select(
                "c", F.when(F.col("e.u") == F.col("c"), F.col("e.v")).otherwise(F.col("e.u")).alias("p"), "n"
            ), {"n": F.count(F.lit(1))})
        hot = hot_keys(chosen, "c", "n", 2 * total)
        # the pair that chose the same edge: its smaller member is the tree's root
        mate = chosen.select(F.col("c").alias("_c"), F.col("p").alias("_p"))
        tree, state = stage.save(
            skew_join(chosen, mate, "p", "_c", hot, "c", right_rows=picked["n"]).select(
                "c", F.when((F.col("_p") == F.col("c")) & (F.col("c") < F.col("p")), F.col("c")).otherwise(F.col("p")).alias("p")
            ).withColumn("done", F.col("c") == F.col("p")), {"n": F.count(F.lit(1)), "open": F.count_if(F.col("c") != F.col("p"))})
        stage.drop(chosen)
        members, open_ = state["n"], state["open"]
        while open_:  # nodes whose pointer has not reached the root yet
            up = tree.select(F.col("c").alias("_c"), F.col("p").alias("_p"), F.col("done").alias("_done"))
            opened = tree.filter(~F.col("done"))
            own = hot or hot_keys(opened.groupBy("p").agg(F.count("*").alias("n")), "p", "n", open_)
            jumped = skew_join(opened, up, "p", "_c", own, "c", right_rows=members).select("c", F.col("_p").alias("p"), F.col("_done").alias("done"))
            before = tree
            tree, state = stage.save(tree.filter("done").unionByName(jumped), {"open": F.count_if(~F.col("done"))})
            stage.drop(before)
            open_ = state["open"]
        rounds.append((tree, members))
        to = tree.select(F.col("c").alias("_c"), F.col("p").alias("_p"))
        left = skew_join(edges, to, "u", "_c", hot, "v", right_rows=members).select(F.col("_p").alias("ru"), "v")
        both = skew_join(left, to, "v", "_c", hot, "ru", right_rows=members).select("ru", F.col("_p").alias("rv"))
        pairs = both.filter("ru <> rv").select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).distinct()
        before = edges
        edges, seen = stage.save(_keyed(pairs), {"n": F.count(F.lit(1))})
        stage.drop(before)

    if not rounds:
        return pairs.select(F.col("u").alias("node"), F.col("u").alias("group_id")).limit(0)
    # roots of the last round are final; earlier rounds look theirs up, from the smallest table down.
    # A root may gather a third of all nodes, so these joins are salted as well.
    final, known = rounds[-1]
    for tree, members in reversed(rounds[:-1]):
        up = final.select(F.col("c").alias("_c"), F.col("p").alias("_p"))
        hot = hot_keys(tree.groupBy("p").agg(F.count("*").alias("n")), "p", "n", members)
        final, known = skew_join(tree, up, "p", "_c", hot, "c", "left", right_rows=known).select("c", F.coalesce("_p", "p").alias("p")), members
    final = stage.save(final)
    least = final.groupBy(F.col("p").alias("_r")).agg(F.min("c").alias("group_id"), F.count("*").alias("_n"))
    hot = hot_keys(least, "_r", "_n", known)
    # group ids are fewer than half the nodes; how few is unknown, so nothing is broadcast above the bound
    return skew_join(final, least.drop("_n"), "p", "_r", hot, "c", right_rows=known).select(F.col("c").alias("node"), "group_id")
