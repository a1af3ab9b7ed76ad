"""Evidence texts for decisions: ordered, bounded lists of titles, children and candidates.

Lists are short by definition (first n entries), so they are ranked first and folded afterwards:
ranks are limited before the shuffle and no group of any size becomes one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_texts(rows: DataFrame, by: str, order: list[Column], text: str, k: int, sep: str = "；", width: int | None = None, name: str = "texts") -> DataFrame:
    """EV-02, EV-03, EV-05: the first k texts per group in order, cut to width, as one text."""
    r = rows.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("_r") <= k)
    t = F.substring(text, 1, width) if width else F.col(text)
    folded = r.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("_r", t.alias("_t")))).alias("_x"))
    return folded.select(by, F.array_join(F.transform("_x", lambda x: x["_t"]), sep).alias(name))


def numbered(titles: Column) -> Column:
    """EV-01: "1. a\\n2. b" of an array."""
    return F.array_join(F.transform(titles, lambda t, i: F.concat((i + 1).cast("string"), F.lit(". "), t)), "\n")


def candidate_listing(candidates: DataFrame, child: str = "child_id", parent: str = "parent_id", score: str = "score", k: int = 3) -> DataFrame:
    """EV-04: top-k parents with scores as text, and the margin between the first two."""
    w = Window.partitionBy(child).orderBy(F.desc(F.round(score, 9)), parent)
    r = candidates.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= max(k, 2)).withColumn("_n", F.lead(score).over(w))
    line = F.concat(F.col(parent).cast("string"), F.lit("="), F.format_number(score, 3))
    return r.groupBy(child).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_r") <= k, F.struct("_r", line.alias("l"))))), lambda x: x["l"]), "; ").alias("listing"),
        F.max(F.when(F.col("_r") == 1, F.col(score) - F.coalesce("_n", F.lit(0.0)))).alias("margin"),
    )


def merge_line(a: Column, b: Column, mean: Column, p75: Column, n: Column) -> Column:
    """EV-07: one line of member titles and scores for a merge decision."""
    return F.concat(a, F.lit(" | "), b, F.lit(" mean="), F.format_number(mean, 2), F.lit(" p75="), F.format_number(p75, 2), F.lit(" n="), n.cast("string"))


def rating_prompt(sample: Column, instruction: str) -> Column:
    """EV-06: instruction and the nested sample as JSON."""
    return F.concat(F.lit(instruction + "\n"), F.to_json(sample))


def summary_text(metrics: dict[str, float | int | None]) -> str:
    """RP-04: aligned lines of collected metrics."""
    width = max((len(k) for k in metrics), default=0)
    return "\n".join(f"{k.ljust(width)}  {'-' if v is None else v}" for k, v in metrics.items())
