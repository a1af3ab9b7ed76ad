"""Rater scores: penalties, agreement, divergence and framework scores, in closed forms.

Ratings have sample_id, judge_key, the dimensions (null: not rated) and flags. Agreement of rater
pairs comes from sums over one wide row per sample, so no pairs of ratings are ever emitted.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Weights of the dimensions, penalties of the flags, weights of the framework score.
NODE_WEIGHTS = {"vertical_coherence": 0.40, "horizontal_coherence": 0.35, "label_quality": 0.25}
PATH_WEIGHTS = {"path_coherence": 0.55, "granularity_progression": 0.45}
NODE_PENALTIES = {
    "PARENT_CHILD_IDENTICAL": 1.0, "ORPHAN_NODE": 1.0, "CIRCULAR_REFERENCE": 1.0, "SIBLING_SEMANTIC_DUPLICATE": 0.5, "LOW_ABSTRACTION_PARENT": 0.5,
    "SEMANTIC_DRIFT_CHILD": 0.5, "UNBALANCED_BRANCHING": 0.5, "GRANULARITY_JUMP": 0.2, "LABEL_TOO_LONG": 0.2, "MIXED_ABSTRACTION_SIBLINGS": 0.2,
}
PATH_PENALTIES = {"PATH_SEMANTIC_DRIFT": 0.8, "PATH_GRANULARITY_JUMP": 0.6, "PATH_REDUNDANT_CHAIN": 0.5, "PATH_OVER_DEEP": 0.4, "PATH_UNDER_STRUCTURED": 0.4}
NODE_SHARE, PATH_SHARE = 0.65, 0.35

#: Raters of a panel are columns of the wide table; panels are small.
MAX_PANEL = 100


def penalty(flags: Column, penalties: dict[str, float]) -> Column:
    """AG-10: sum over flags, repeated ones counting again, unknown ones 0."""
    table = F.create_map(*[x for k, v in penalties.items() for x in (F.lit(k), F.lit(v))])
    return F.aggregate(F.coalesce(flags, F.array().cast("array<string>")), F.lit(0.0), lambda a, f: a + F.coalesce(F.try_element_at(table, f), F.lit(0.0)))


def weighted_scores(ratings: DataFrame, weights: dict[str, float], penalties: dict[str, float]) -> DataFrame:
    """AG-10: raw (null unless every dimension is rated) and adjusted = max(1, raw - penalties)."""
    raw = sum((F.col(d) * w for d, w in weights.items()), F.lit(0.0))
    return ratings.withColumn("raw", raw).withColumn("adjusted", F.when(raw.isNotNull(), F.greatest(F.lit(1.0), raw - penalty(F.col("flags"), penalties))))


def panel(ratings: DataFrame) -> list[str]:
    """The raters, in order."""
    names = [r[0] for r in ratings.select("judge_key").distinct().limit(MAX_PANEL + 1).collect()]
    if len(names) > MAX_PANEL:
        raise ValueError(f"more than {MAX_PANEL} raters")
    return sorted(n for n in names if n is not None)


def wide(ratings: DataFrame, dim: str, judges: list[str], by: list[str] | None = None) -> DataFrame:
    """One row per sample with a column per rater."""
    return ratings.groupBy(*(by or []), "sample_id").pivot("judge_key", judges).agg(F.max(dim))


def pairwise_kappa(ratings: DataFrame, dim: str, judges: list[str], by: list[str] | None = None, k: int = 5) -> DataFrame:
    """AG-11, JN-12: (by.., judge_a, judge_b, n, weighted_kappa) with quadratic weights.

    With ratings in 1..k the kappa is 1 - mean (a-b)^2 / (E a^2 + E b^2 - 2 E a E b) over the samples
    both rated; null when the denominator is 0.
    """
    by = by or []
    w = wide(ratings, dim, judges, by)
    pairs = list(combinations(judges, 2))
    out = []
    aggs = []
    for i, (a, b) in enumerate(pairs):
        x = F.when(F.col(f"`{b}`").isNotNull(), F.col(f"`{a}`")).cast("double")
        y = F.when(F.col(f"`{a}`").isNotNull(), F.col(f"`{b}`")).cast("double")
        aggs += [F.count(x).alias(f"n{i}"), F.avg((x - y) * (x - y)).alias(f"d{i}"), F.avg(x * x).alias(f"xx{i}"), F.avg(y * y).alias(f"yy{i}"), F.avg(x).alias(f"x{i}"), F.avg(y).alias(f"y{i}")]
        den = F.col(f"xx{i}") + F.col(f"yy{i}") - 2 * F.col(f"x{i}") * F.col(f"y{i}")
        out.append(F.struct(F.lit(a).alias("judge_a"), F.lit(b).alias("judge_b"), F.col(f"n{i}").alias("n"), F.when(den > 1e-12, 1 - F.col(f"d{i}") / den).alias("weighted_kappa")))
    sums = w.groupBy(*by).agg(*aggs)
    return sums.select(*by, F.explode(F.array(*out)).alias("_p")).select(*by, "_p.*")


def interval_alpha(ratings: DataFrame, dim: str, by: list[str] | None = None) -> DataFrame:
    """AG-12: (by.., alpha) = 1 - within / pooled mean squared difference over all rating pairs, from
    sum (a-b)^2 over pairs = n sum x^2 - (sum x)^2; samples rated once count for nothing."""
    by = by or []
    x = F.col(dim).cast("double")
    per = ratings.filter(F.col(dim).isNotNull()).groupBy(*by, "sample_id").agg(F.count("*").alias("n"), F.sum(x).alias("s"), F.sum(x * x).alias("q")).filter("n > 1")
    sums = per.groupBy(*by).agg(F.sum(F.col("n") * F.col("q") - F.col("s") * F.col("s")).alias("w"), F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("p"), F.sum("n").alias("N"), F.sum("s").alias("S"), F.sum("q").alias("Q"))
    expected = (F.col("N") * F.col("Q") - F.col("S") * F.col("S")) / (F.col("N") * (F.col("N") - 1) / 2)
    return sums.select(*by, F.when(expected > 0, 1 - (F.col("w") / F.col("p")) / expected).alias("alpha"))


def binary_kappa(n: Column, agree: Column, a: Column, b: Column) -> Column:
    """AG-13 from counts: rated by both, equal, positives of each; null when chance agreement is 1."""
    pa, pb = a / n, b / n
    chance = pa * pb + (1 - pa) * (1 - pb)
    return F.when((n > 0) & (F.abs(chance - 1) > 1e-12), (agree / n - chance) / (1 - chance))


def flag_agreement(ratings: DataFrame, flags: list[str], judges: list[str]) -> DataFrame:
    """AG-14: per flag over the samples every rater judged: n_evaluated, full and majority agreement,
    mean pairwise kappa and the rate of every rater."""
    rows = ratings.groupBy("sample_id").pivot("judge_key", judges).agg(F.max(F.coalesce("flags", F.array().cast("array<string>"))))
    rows = rows.filter(" and ".join(f"`{j}` is not null" for j in judges))
    each = rows.select(F.explode(F.array(*map(F.lit, flags))).alias("flag"), *[F.col(f"`{j}`") for j in judges])
    bits = each.select("flag", *[F.array_contains(f"`{j}`", F.col("flag")).cast("int").alias(f"v{i}") for i, j in enumerate(judges)])
    total = sum((F.col(f"v{i}") for i in range(len(judges))), F.lit(0))
    aggs = [F.count("*").alias("n_evaluated"), F.avg(((total == 0) | (total == len(judges))).cast("int")).alias("full_agreement"), F.avg((F.greatest(total, len(judges) - total) > len(judges) / 2).cast("int")).alias("majority_agreement")]
    aggs += [F.sum(f"v{i}").alias(f"s{i}") for i in range(len(judges))]
    pairs = list(combinations(range(len(judges)), 2))
    aggs += [F.sum((F.col(f"v{i}") == F.col(f"v{j}")).cast("int")).alias(f"e{i}_{j}") for i, j in pairs]
    g = bits.groupBy("flag").agg(*aggs)
    kappas = F.array_compact(F.array(*[binary_kappa(F.col("n_evaluated"), F.col(f"e{i}_{j}"), F.col(f"s{i}"), F.col(f"s{j}")) for i, j in pairs]))
    mean = F.when(F.size(kappas) > 0, F.aggregate(kappas, F.lit(0.0), lambda a, x: a + x) / F.size(kappas))
    return g.select("flag", "n_evaluated", "full_agreement", "majority_agreement", mean.alias("mean_kappa"), *[(F.col(f"s{i}") / F.col("n_evaluated")).alias(f"rate_{j}") for i, j in enumerate(judges)])


def divergent(ratings: DataFrame, dims: list[str], n_judges: int, threshold: int = 2) -> DataFrame:
    """AG-16: samples all raters judged, whose ratings of a dimension lie threshold apart or whose
    flag sets differ: sample_id, max_score_diff, flag_disagree. One row per sample and rater in."""
    flags = F.array_join(F.array_sort(F.array_distinct(F.coalesce("flags", F.array().cast("array<string>")))), "|")
    g = ratings.groupBy("sample_id").agg(F.count_distinct("judge_key").alias("k"), *[(F.max(d) - F.min(d)).alias(f"_{d}") for d in dims], F.min(flags).alias("_a"), F.max(flags).alias("_b"))
    diff = F.greatest(*[F.coalesce(f"_{d}", F.lit(0)) for d in dims], F.lit(0))
    return g.filter(F.col("k") == n_judges).select("sample_id", diff.alias("max_score_diff"), (F.col("_a") != F.col("_b")).alias("flag_disagree")).filter((F.col("max_score_diff") >= threshold) | F.col("flag_disagree"))


def framework(node: DataFrame, path: DataFrame) -> DataFrame:
    """AG-17: per rater mean adjusted node and path score and 0.65 node + 0.35 path, or the one that
    exists. node, path: judge_key, adjusted."""
    n = node.filter("adjusted is not null").groupBy("judge_key").agg(F.avg("adjusted").alias("mean_node"))
    p = path.filter("adjusted is not null").groupBy("judge_key").agg(F.avg("adjusted").alias("mean_path"))
    both = n.join(p, "judge_key", "full_outer")
    return both.withColumn("framework", F.coalesce(F.col("mean_node") * NODE_SHARE + F.col("mean_path") * PATH_SHARE, "mean_node", "mean_path"))
