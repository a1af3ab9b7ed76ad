"""Edge contraction, threshold graphs, components, clusters and parent assignment."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborlake.functions.text import jaccard, node_id, tokens
from arborlake.operators.ranking import full_rank
from arborlake.runtime import Stage, hot_keys, lookup, skew_join


#: Top-level categories of a definition list, at most.
MAX_CATEGORIES = 1_000

#: Numbers of parents in one block of nearest_candidates, without the overlap of neighbouring blocks.
NEAR_BLOCK = 64


def trimmed_mean(x, share: float = 0.1):
    """AG-02: mean of an array of scores without floor(share * n) at each end."""
    s = F.array_sort(x)
    k = F.floor(F.size(x) * share).cast("int")
    core = F.slice(s, k + 1, F.size(x) - 2 * k)
    return F.when(F.size(x) > 0, F.aggregate(core, F.lit(0.0), lambda a, v: a + v) / F.size(core))


def contract_edges(pairs: DataFrame, members: DataFrame, score: str = "sim") -> DataFrame:
    """AG-01..04, JN-01: pair scores between nodes: (node_a < node_b, score_mean, score_p75,
    score_max, pair_count). Pairs inside a node or with an unknown end drop out; both directions
    of a pair count.

    Trimmed mean and percentile (linear) are sums over ranked scores, so a node pair with any number
    of scores is spread over tasks and never one list.
    """
    m = members.select("node_id", "member_id").distinct()
    one, other = m.select(F.col("member_id").alias("_ma"), F.col("node_id").alias("na")), m.select(F.col("member_id").alias("_mb"), F.col("node_id").alias("nb"))
    # an id may hold a large share of all pairs; a member of several nodes counts in each
    mapped = lookup(lookup(pairs, one, "id_a", "_ma", "id_b"), other, "id_b", "_mb", "id_a")
    ends = mapped.filter("na <> nb").select(F.least("na", "nb").alias("node_a"), F.greatest("na", "nb").alias("node_b"), F.col(score).cast("double").alias("s")).filter("s is not null")
    keyed = ends.withColumn("_g", F.struct(F.col("node_a").alias("a"), F.col("node_b").alias("b")))
    ranked = full_rank(keyed, "_g", [F.asc("s")], "_r", total="_t")
    k, at = F.floor(F.col("_t") * 0.1), (F.col("_t") - 1) * 0.75
    low = F.floor(at)
    share = F.when(F.col("_r") == low + 1, 1 - (at - low)).when(F.col("_r") == low + 2, at - low).otherwise(0.0)
    return ranked.groupBy("node_a", "node_b").agg(
        F.avg(F.when((F.col("_r") > k) & (F.col("_r") <= F.col("_t") - k), F.col("s"))).alias("score_mean"), F.sum(share * F.col("s")).alias("score_p75"), F.max("s").alias("score_max"), F.count("*").alias("pair_count")
    )


def high_graph(edges: DataFrame, nodes: DataFrame, threshold: float, score: str = "sim", key: str = "id") -> DataFrame:
    """GR-01: symmetric (a, b) of edges at or above the threshold with both ends among the nodes."""
    ids = nodes.select(F.col(key).alias("_id")).distinct()
    kept = edges.filter(F.col(score) >= threshold).select("id_a", "id_b")
    kept = lookup(lookup(kept, ids, "id_a", "_id", "id_b", "left_semi"), ids, "id_b", "_id", "id_a", "left_semi")
    one = kept.select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))
    return one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()


def components(nodes: DataFrame, graph: DataFrame, key: str = "id", max_rounds: int = 200) -> DataFrame:
    """GR-02: (id, component) with the smallest member as the component; isolated nodes are their own.

    Large-star / small-star rewriting: every edge set keeps its components while ends move to their
    smallest neighbour, until all edges are stars. Rounds grow with the logarithm of the diameter.
    """
    stage = Stage(nodes.sparkSession, "stars")
    edges = graph.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    edges, seen = stage.save(edges, {"n": F.count(F.lit(1)), "h": F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))})
    for _ in range(max_rounds):
        if not seen["n"]:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("_n")).select(F.col("u").alias("_u"), F.least("u", "m").alias("m"), "_n")
        hot = hot_keys(low, "_u", "_n", 2 * seen["n"])
        large = skew_join(both, low.drop("_n"), "u", "_u", hot, "v").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("_n")).withColumnRenamed("u", "_u")
        hot = hot_keys(least, "_u", "_n", 2 * seen["n"])
        small = skew_join(large, least.drop("_n"), "u", "_u", hot, "v").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").filter("u <> v").distinct()
        before, old = edges, seen
        edges, seen = stage.save(small, {"n": F.count(F.lit(1)), "h": F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))})
        stage.drop(before)
        if (seen["n"], seen["h"]) == (old["n"], old["h"]):
            break
    else:
        raise RuntimeError(f"components not settled after {max_rounds} rounds")
    star = edges.groupBy("u").agg(F.min("v").alias("component"))
    return nodes.select(F.col(key).alias("id")).distinct().join(star, F.col("id") == F.col("u"), "left").select("id", F.coalesce("component", "id").alias("component"))


def mid_band(contracted: DataFrame, low: float, high: float) -> DataFrame:
    """GR-03."""
    return contracted.filter((F.col("score_p75") >= low) & (F.col("score_p75") < high))


def merge_approved(clusters: DataFrame, candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """GR-04: (node, merged) after joining candidate pairs whose decision is to merge; without a
    decision there is no merge. With fixed decisions the order of merging changes nothing, so the
    result is the components of the approved pairs."""
    ok = decisions.filter("merge").select(F.least("node_a", "node_b").alias("node_a"), F.greatest("node_a", "node_b").alias("node_b")).distinct()
    agreed = candidates.join(ok, ["node_a", "node_b"], "left_semi")
    graph = agreed.select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
    return components(clusters.select(F.col("node_id").alias("id")), graph).select(F.col("id").alias("node_id"), F.col("component").alias("merged"))


def emit_clusters(membership: DataFrame, labels: DataFrame, level: int, by: list[str] | None = None) -> DataFrame:
    """GR-05, GR-06: (by.., node_id, label, provenance, size) per cluster of (by.., cluster, member).

    The id hashes the sorted distinct members; the label is that of the smallest member; categories
    are grouping keys and no loop.
    """
    by = by or []
    named = membership.join(labels.select(F.col("member_id"), F.col("label").alias("_l")), "member_id", "left")
    g = named.groupBy(*by, "cluster").agg(F.collect_set("member_id").alias("_m"), F.min(F.struct("member_id", F.col("_l"))).alias("_first"))
    size = F.size("_m")
    return g.select(*by, "cluster", node_id(F.lit(level), F.col("_m")).alias("node_id"), F.col("_first._l").alias("label"), F.when(size > 1, "merge-cc").otherwise("seed-existing").alias("provenance"), size.alias("size"))


def scored_candidates(children: DataFrame, parents: DataFrame, score, k: int, by: str = "l1", near: tuple[str, str] | None = None) -> DataFrame:
    """ST-02, JN-03: (child_id, parent_id, score, rank) of the k best parents of a child's category.

    score is an expression over c_<child column> and p_<parent column>; ties take the smaller id.
    Children of a category that holds many are spread over tasks, and only k rows a child and task
    are shuffled, though every parent of the category is scored. near (child column, parent column)
    says that score is a function of these two numbers, null where one is null, that does not rise
    with their distance: then a child meets only the parents next to its number (nearest_candidates).
    """
    if near:
        return _best(nearest_candidates(children, parents, score, k, by, near), k)
    c = children.select(F.col("node_id").alias("child_id"), F.col(by).alias("_by"), *[F.col(x).alias(f"c_{x}") for x in children.columns if x not in ("node_id", by)])
    p = parents.select(F.col("node_id").cast("string").alias("parent_id"), F.col(by).alias("_bp"), *[F.col(x).alias(f"p_{x}") for x in parents.columns if x not in ("node_id", by)])
    scored = lookup(c, p, "_by", "_bp", "child_id").select("child_id", "parent_id", score.alias("score"))
    return _best(scored, k)


def nearest_candidates(children: DataFrame, parents: DataFrame, score: Callable[[Column, Column], Column], k: int, by: str, near: tuple[str, str]) -> DataFrame:
    """(child_id, parent_id, score) with the k best parents of every child, by sorting.

    Parents of one number need only their k smallest ids. The numbers of a category are ranked and cut
    into blocks; a child takes the k + 1 numbers at either side of its own from its block, at a cost that
    does not grow with the parents. The outer two only tell whether more of them may tie with the k-th
    best; such children, those with fewer than k parents next to them and infinite numbers meet all
    numbers of their category.
    """
    stage = Stage(children.sparkSession, "nearest")
    c = children.select(F.col("node_id").alias("child_id"), F.col(by).alias("_by"), F.col(near[0]).cast("double").alias("_v")).filter("_by is not null")
    p = parents.select(F.col("node_id").cast("string").alias("parent_id"), F.col(by).alias("_bp"), F.col(near[1]).cast("double").alias("_pv")).filter("_bp is not null")
    few = p.withColumn("_r", F.row_number().over(Window.partitionBy("_bp", "_pv").orderBy("parent_id"))).filter(F.col("_r") <= k).drop("_r")
    few, seen = stage.save(few, {"nan": F.count_if(F.isnan("_pv"))})
    values = few.filter("_pv is not null and not isnan(_pv)").groupBy("_bp", "_pv").agg(F.collect_list("parent_id").alias("_ids"))
    key = lambda group: F.concat_ws("\x01", F.col(group).cast("string"), F.col("_block").cast("string"))
    at = full_rank(values, "_bp", [F.asc("_pv")], "_at")
    blocks = at.withColumn("_block", F.explode(F.sequence(F.greatest(F.lit(0), F.floor((F.col("_at") - k - 1) / NEAR_BLOCK)), F.floor((F.col("_at") + k) / NEAR_BLOCK))))
    blocks = blocks.groupBy(key("_bp").alias("_bk")).agg(F.sort_array(F.collect_list(F.struct("_at", "_pv", "_ids"))).alias("_x"))

    plain = F.coalesce(F.abs("_v") < float("inf"), F.lit(False))
    both = c.filter(plain).withColumn("_p", F.lit(False)).unionByName(values.select(F.col("_bp").alias("_by"), F.col("_pv").alias("_v"), F.lit(True).alias("_p")), allowMissingColumns=True)
    placed = full_rank(both, "_by", [F.asc("_v"), F.desc("_p")], "_n", of=F.col("_p")).filter("not _p").withColumn("_block", F.floor(F.col("_n") / NEAR_BLOCK))
    placed = stage.save(placed.select("child_id", "_by", "_v", "_n", key("_by").alias("_k")))
    n = F.col("_n")
    start = F.get("_x", F.lit(0))["_at"]
    first = F.greatest(start, n - k)
    around = F.slice("_x", first - start + 1, n + k + 2 - first)
    met = lookup(placed, blocks, "_k", "_bk", "child_id", "left").withColumn("_s", F.transform(around, lambda x: F.struct(score(F.col("_v"), x["_pv"]).alias("score"), x["_ids"].alias("ids"), x["_at"].isin(n - k, n + k + 1).alias("outer"))))
    met = met.withColumn("_s", F.transform("_s", lambda x: x.withField("r", -F.round(x["score"], 9))))
    met = met.withColumn("_c", F.slice(F.sort_array(F.flatten(F.transform("_s", lambda x: F.transform(x["ids"], lambda i: F.struct(x["r"].alias("r"), i.alias("parent_id"), x["score"].alias("score")))))), 1, k))
    last = F.get("_c", F.lit(k - 1))["r"]
    met = met.withColumn("_open", F.coalesce(F.size("_c") < k, F.lit(True)) | F.coalesce(F.exists("_s", lambda x: x["outer"] & (x["r"] <= last)), F.lit(False)))
    met, left = stage.save(met.select("child_id", "_by", "_v", "_open", F.when(~F.col("_open"), F.col("_c")).alias("_c")), {"n": F.count_if("_open")})
    stage.drop(placed)

    out = met.filter("not _open").select("child_id", F.inline("_c")).select("child_id", "parent_id", "score")
    pairs = lambda some, those: lookup(some, those, "_by", "_bp", "child_id").select("child_id", "parent_id", score(F.col("_v"), F.col("_pv")).alias("score"))
    if seen["nan"]:  # they rank first with every child
        out = out.unionByName(pairs(met.filter("not _open"), few.filter(F.isnan("_pv"))))
    if left["n"]:
        out = out.unionByName(pairs(met.filter("_open"), few))
    far = c.filter(~plain)
    if not far.isEmpty():
        # null and NaN make all scores alike: the first ids, before and after those without a number
        low = lambda *order: F.row_number().over(Window.partitionBy("_bp").orderBy(*order))
        firsts = few.withColumns({"_r": low("parent_id"), "_q": low(F.col("_pv").isNull(), "parent_id")}).filter((F.col("_r") <= k) | (F.col("_q") <= k))
        blind = F.isnan("_v") | F.col("_v").isNull()
        out = out.unionByName(pairs(far.filter(blind), firsts)).unionByName(pairs(far.filter(~blind), few))
    return out


def _best(scored: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("child_id").orderBy(F.desc(F.round("score", 9)), "parent_id")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _new_id(child):
    return F.concat(F.lit("NEW_"), F.substring(F.md5(child.cast("string")), 1, 8))


def created_parents(children: DataFrame, static: DataFrame, score, wishes: DataFrame, hard: float, as_parent: dict[str, str], by: str) -> DataFrame:
    """GR-07: (node_id, by, <parent columns>, _child) of the parents that children create, in the order of
    child ids: a child that wants one, or the first of a category without parents, creates it unless
    a parent at or above hard is there, one created by an earlier child included.

    Who creates is settled in rounds: a child waits for the earlier ones whose parent would do for it.
    Wishes come one by one from people or models, so they are few beside the children.
    """
    stage = Stage(children.sparkSession, "created")
    best = static.filter("rank = 1").select(F.col("child_id").alias("_c"), F.col("score").alias("_s"))
    with_best = children.join(best, F.col("node_id") == F.col("_c"), "left").drop("_c")
    bare = with_best.groupBy(F.col(by).alias("_g")).agg(F.count("_s").alias("_n"), F.min("node_id").alias("_first")).filter("_n = 0").select(F.col("_first").alias("_w"))
    wanted = bare.unionByName(wishes.select(F.col("node_id").alias("_w"))).distinct()
    able = stage.save(with_best.filter(F.coalesce(F.col("_s") < hard, F.lit(True))).join(wanted, F.col("node_id") == F.col("_w"), "left_semi").drop("_s"))
    own = able.select(_new_id(F.col("node_id")).alias("node_id"), by, F.col("node_id").alias("_child"), *[F.col(c).alias(p) for c, p in as_parent.items()])
    c = able.select(F.col("node_id").alias("child_id"), F.col(by).alias("_by"), *[F.col(x).alias(f"c_{x}") for x in able.columns if x not in ("node_id", by)])
    p = own.select(F.col("_child").alias("_j"), F.col(by).alias("_bp"), *[F.col(x).alias(f"p_{x}") for x in as_parent.values()])
    blocks = stage.save(lookup(c, p, "_by", "_bp", "child_id").filter((F.col("_j") < F.col("child_id")) & (score >= hard)).select("child_id", "_j"))
    open_, seen = stage.save(able.select("node_id", F.lit(0).alias("state")), {"n": F.count(F.lit(1))})
    while seen["n"]:  # state 0 waits, 1 creates, 2 does not
        state = open_.select(F.col("node_id").alias("_b"), F.col("state").alias("_bs"))
        met = blocks.join(state, F.col("_j") == F.col("_b")).groupBy(F.col("child_id").alias("_i")).agg(F.count_if(F.col("_bs") == 1).alias("_yes"), F.count_if(F.col("_bs") == 0).alias("_wait"))
        step = open_.join(met, F.col("node_id") == F.col("_i"), "left").select(
            "node_id", F.when(F.col("state") > 0, F.col("state")).when(F.col("_yes") > 0, 2).when(F.coalesce("_wait", F.lit(0)) > 0, 0).otherwise(1).alias("state"))
        before = open_
        open_, seen = stage.save(step, {"n": F.count_if(F.col("state") == 0)})
        stage.drop(before)
    return own.join(open_.filter("state = 1").select(F.col("node_id").alias("_child")), "_child", "left_semi")


def assign_parents(children: DataFrame, parents: DataFrame, score, decisions: DataFrame | None = None, k: int = 5, hard: float = 0.92, by: str = "l1", as_parent: dict[str, str] | None = None, top: DataFrame | None = None) -> DataFrame:
    """GR-07, JN-03: (child_id, parent_id, decision, confidence, margin) per child.

    Candidates share the category; the best at or above hard is taken as it is (hard_assign), then a
    decision among the top k (model_assign), else the top one (fallback_top1). decisions: child_id,
    parent_id, confidence and, optionally, create: a wish for a parent of its own (model_create).
    as_parent (child column -> parent column) makes created parents candidates of later children, in
    the order of child ids; without it every child without candidates creates one of its own.
    top: scored_candidates of the same tables, where they are at hand.
    """
    spark = children.sparkSession
    kind = children.schema["node_id"].dataType.simpleString()
    if decisions is None:
        decisions = spark.createDataFrame([], f"child_id {kind}, parent_id string, confidence double")
    create = F.coalesce(F.col("create"), F.lit(False)) if "create" in decisions.columns else F.lit(False)
    top = scored_candidates(children, parents, score, k, by) if top is None else top
    if as_parent is not None:
        stage = Stage(spark, "assign")
        top = stage.save(top)
        made = stage.save(created_parents(children, top, score, decisions.filter(create).select(F.col("child_id").alias("node_id")), hard, as_parent, by))
        mine = made.select(F.col("_child").alias("_mc"), F.col("node_id").alias("_mine"))
        top = _best(top.drop("rank").unionByName(_later(children, made, score, by)), k)
    else:
        mine = None
    # one row a child, with at most k ids: all that follows is joined by child, as the ranks are placed
    at = lambda rank, c: F.max(F.when(F.col("rank") == rank, F.col(c)))
    best = top.groupBy(F.col("child_id").alias("_cc")).agg(at(1, "parent_id").alias("_top"), at(1, "score").alias("_s"), at(2, "score").alias("_next"), F.collect_list("parent_id").alias("_ids"))
    chosen = best.select("_cc", "_top", "_s", (F.col("_s") - F.coalesce("_next", F.lit(0.0))).alias("margin"))
    out = children.select(F.col("node_id").alias("child_id")).join(chosen, F.col("child_id") == F.col("_cc"), "left").drop("_cc")
    given = decisions.filter(~create).select("child_id", "parent_id", "confidence")
    valid = given.join(best.select("_cc", "_ids"), F.col("child_id") == F.col("_cc")).filter(F.array_contains("_ids", F.col("parent_id"))).groupBy("child_id").agg(F.max_by(F.struct("parent_id", "confidence"), F.struct("confidence", "parent_id")).alias("x"))
    out = out.join(valid.select("child_id", F.col("x.parent_id").alias("_d"), F.col("x.confidence").alias("_c")), "child_id", "left")
    if mine is None:
        out = out.withColumn("_mine", F.when(F.col("_top").isNull(), _new_id(F.col("child_id"))))
    else:
        out = out.join(mine, F.col("child_id") == F.col("_mc"), "left").drop("_mc")
    wished = decisions.filter(create).select(F.col("child_id").alias("_w")).distinct()
    out = out.join(wished, F.col("child_id") == F.col("_w"), "left")
    sure = F.coalesce(F.col("_s") >= hard, F.lit(False))
    made_one = F.col("_mine").isNotNull()
    return out.select(
        "child_id",
        F.when(made_one, F.col("_mine")).when(sure, F.col("_top")).otherwise(F.coalesce("_d", "_top")).alias("parent_id"),
        F.when(made_one, F.when(F.col("_w").isNotNull() & F.col("_top").isNotNull(), "model_create").otherwise("create")).when(sure, "hard_assign").when(F.col("_d").isNotNull(), "model_assign").otherwise("fallback_top1").alias("decision"),
        F.when(made_one, 0.0).when(sure, F.col("_s")).otherwise(F.coalesce("_c", F.lit(0.0))).alias("confidence"), "margin",
    )


def _later(children: DataFrame, made: DataFrame, score, by: str) -> DataFrame:
    """(child_id, parent_id, score) of created parents and the later children of their category."""
    c = children.select(F.col("node_id").alias("child_id"), F.col(by).alias("_by"), *[F.col(x).alias(f"c_{x}") for x in children.columns if x not in ("node_id", by)])
    p = made.select(F.col("node_id").alias("parent_id"), "_child", F.col(by).alias("_bp"), *[F.col(x).alias(f"p_{x}") for x in made.columns if x not in ("node_id", "_child", by)])
    return lookup(c, p, "_by", "_bp", "child_id").filter(F.col("_child") < F.col("child_id")).select("child_id", "parent_id", score.alias("score"))


def top_categories(members: DataFrame, labels: DataFrame, tops: DataFrame, k: int = 5) -> DataFrame:
    """ST-03: (node_id, category, score, rank) of the k best top categories per node by votes plus label
    overlap; ties take the smaller id. tops is a short definition list, held as one literal array."""
    listed = tops.select("id", "label").limit(MAX_CATEGORIES + 1).collect()
    if len(listed) > MAX_CATEGORIES:
        raise ValueError(f"more than {MAX_CATEGORIES} top categories")
    all_tops = F.array(*[F.struct(F.lit(r.id).alias("id"), F.lit(r.label).alias("label")) for r in listed])
    votes = members.filter(F.col("l1").isin([r.id for r in listed])).groupBy(F.col("node_id").alias("_n"), F.col("l1").alias("_l")).agg(F.count("*").alias("_v"))
    cand = labels.select("node_id", "label", F.explode(all_tops).alias("t")).join(votes, (F.col("node_id") == F.col("_n")) & (F.col("t.id") == F.col("_l")), "left")
    scored = cand.select("node_id", F.col("t.id").alias("category"), (F.coalesce("_v", F.lit(0)) + jaccard(tokens(F.col("label")), tokens(F.col("t.label")))).alias("score"))
    w = Window.partitionBy("node_id").orderBy(F.desc(F.round("score", 9)), "category")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def vote_link(members: DataFrame, labels: DataFrame, tops: DataFrame, threshold: float = 0.5, fast: DataFrame | None = None, audit: DataFrame | None = None, accept: float = 0.85) -> tuple[DataFrame, DataFrame]:
    """GR-08, AG-06: (links, new categories). links: node_id, parent_id, decision, confidence, ratio,
    is_new_parent.

    1. Votes: members (node_id, l1 or null), known l1 only, against all members; at or above the
       threshold the vote decides (R1_Hard_Link, the ratio as confidence).
    2. fast (node_id, best_id, confidence, create_new): a known category with a confidence of accept
       or more (R2_Fast_Match).
    3. audit (the same and new_label): a known category, or a new one named by new_label (the node's
       label without one). The first node in order creates it (R3_New_Created), others and names that
       exist take what is there; without a valid answer the best of votes plus label overlap
       (R3_Deep_Audit, .5 where no confidence is given).

    A category created for a node is known to later nodes. new categories: node_id, label, size.
    """
    sizes = members.groupBy("node_id").agg(F.count("*").alias("n"))
    votes = members.join(tops.select(F.col("id").alias("l1")), "l1").groupBy("node_id", "l1").agg(F.count("*").alias("v"))
    first = votes.join(sizes, "node_id").groupBy("node_id").agg(F.min_by(F.struct("l1", (F.col("v") / F.col("n")).alias("r")), F.struct(-F.col("v"), "l1")).alias("x")).select("node_id", F.col("x.l1").alias("_best"), F.col("x.r").alias("ratio"))
    base = sizes.join(first, "node_id", "left").withColumn("ratio", F.coalesce("ratio", F.lit(0.0)))
    undecided = base.filter(F.col("ratio") < threshold).select("node_id", "n").join(labels.select("node_id", "label"), "node_id", "left")
    top1 = top_categories(members, undecided.select("node_id", "label"), tops, 1).select(F.col("node_id").alias("_tn"), F.col("category").alias("_fall"))
    kind = members.schema["node_id"].dataType.simpleString()
    empty = members.sparkSession.createDataFrame([], f"node_id {kind}, best_id string, confidence double, create_new boolean, new_label string")
    one = lambda d, *more: (d if d is not None else empty).groupBy(F.col("node_id").alias("_dn")).agg(F.max_by(F.struct("best_id", "confidence", F.coalesce("create_new", F.lit(False)).alias("create_new"), *more), F.struct("confidence", "best_id")).alias("d"))
    known = tops.select(F.col("id").alias("_id"), F.col("label").alias("_name"))
    # categories a deep audit creates, by the first node that names one
    a3 = undecided.join(one(audit, "new_label"), F.col("node_id") == F.col("_dn"), "left").select("node_id", "n", "label", F.col("d").alias("d3"))
    wish = F.when(F.col("d3.create_new"), F.trim(F.coalesce(F.nullif(F.trim("d3.new_label"), F.lit("")), "label")))
    asked = a3.withColumn("wish", wish)
    settled = asked.join(one(fast).select(F.col("_dn").alias("_fn"), F.col("d").alias("d2")), F.col("node_id") == F.col("_fn"), "left").join(known.select(F.col("_id").alias("_k2")), F.col("d2.best_id") == F.col("_k2"), "left")
    quick = ~F.coalesce("d2.create_new", F.lit(False)) & (F.col("d2.confidence") >= accept) & F.col("d2.best_id").isNotNull()
    deep = settled.filter(~F.coalesce(quick & F.col("_k2").isNotNull(), F.lit(False)) & F.col("wish").isNotNull())
    new = deep.join(known, F.col("wish") == F.col("_name"), "left_anti").groupBy("wish").agg(F.min_by(F.struct("node_id", "n"), "node_id").alias("x"))
    new = new.select(F.concat(F.lit("L1_N"), F.substring(F.md5("wish"), 1, 8)).alias("_id"), F.col("wish").alias("_name"), F.col("x.node_id").alias("_by"), F.col("x.n").alias("_size"))
    stage = Stage(members.sparkSession, "votes")
    new = stage.save(new)
    all_ids = known.select("_id", "_name", F.lit(None).cast(kind).alias("_by")).unionByName(new.select("_id", "_name", "_by"))
    as_ = lambda name: all_ids.select(*[F.col(c).alias(f"{name}{c}") for c in ("_id", "_name", "_by")])
    s = settled.drop("_k2").join(as_("f"), (F.col("d2.best_id") == F.col("f_id")) & (F.col("f_by").isNull() | (F.col("f_by") < F.col("node_id"))), "left")
    s = s.join(as_("w"), F.col("wish") == F.col("w_name"), "left")
    s = s.join(as_("b"), (F.col("d3.best_id") == F.col("b_id")) & (F.col("b_by").isNull() | (F.col("b_by") < F.col("node_id"))), "left").join(top1, F.col("node_id") == F.col("_tn"), "left")
    hit = F.coalesce(quick & F.col("f_id").isNotNull(), F.lit(False))
    made = F.coalesce(F.col("w_by") == F.col("node_id"), F.lit(False))
    late = s.select(
        F.col("node_id").alias("_ln"), F.when(hit, F.col("f_id")).otherwise(F.coalesce("w_id", "b_id", "_fall")).alias("_to"), F.when(hit, "R2_Fast_Match").when(made, "R3_New_Created").otherwise("R3_Deep_Audit").alias("_how"),
        F.when(hit, F.col("d2.confidence")).otherwise(F.coalesce(F.nullif(F.col("d3.confidence"), F.lit(0.0)), F.lit(0.5))).alias("_conf"), (~hit & made).alias("_new"),
    )
    decided = F.col("ratio") >= threshold
    links = base.join(late, F.col("node_id") == F.col("_ln"), "left").select(
        "node_id", F.when(decided, F.col("_best")).otherwise(F.col("_to")).alias("parent_id"), F.when(decided, "R1_Hard_Link").otherwise(F.col("_how")).alias("decision"),
        F.when(decided, F.col("ratio")).otherwise(F.col("_conf")).alias("confidence"), "ratio", F.coalesce("_new", F.lit(False)).alias("is_new_parent"),
    )
    return links, new.select(F.col("_id").alias("node_id"), F.col("_name").alias("label"), F.col("_size").alias("size"))


def recontract(pairs: DataFrame, members: DataFrame, new_members: DataFrame, old: DataFrame, score: str = "sim") -> DataFrame:
    """HP-04: edges of a level after parents were created: those of the new nodes contracted from the
    pair scores, the old ones kept; of an edge in both the new row counts."""
    m = members.select("node_id", "member_id").unionByName(new_members.select("node_id", "member_id"))
    fresh = new_members.select(F.col("node_id").alias("_n")).distinct()
    made = contract_edges(pairs, m, score)
    made = made.join(fresh.withColumnRenamed("_n", "_a"), F.col("node_a") == F.col("_a"), "left").join(fresh.withColumnRenamed("_n", "_b"), F.col("node_b") == F.col("_b"), "left").filter("_a is not null or _b is not null").drop("_a", "_b")
    stage = Stage(pairs.sparkSession, "recontract")
    made = stage.save(made)
    return old.join(made.select("node_a", "node_b"), ["node_a", "node_b"], "left_anti").select(*made.columns).unionByName(made)
