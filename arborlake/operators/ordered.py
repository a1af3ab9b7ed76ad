"""Operators over ordered, heading-levelled document blocks: window expressions, no row-wise stacks.

Blocks have doc, pos (unique within a doc), level (1..4, null for body) and text. Windows partition
by document: a document is the unit of order, and its size does not grow with the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEEPEST = 4


def _before(doc: str, pos: str):
    return Window.partitionBy(doc).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)


def heading_path(blocks: DataFrame, doc: str = "doc", pos: str = "pos", level: str = "level", text: str = "text", skip: Column | None = None, name: str = "path") -> DataFrame:
    """WN-01: titles of the nearest open ancestors, joined by ' > '.

    The last heading of level i is open when no shallower heading came after it. Skipped and blank
    headings keep their place but not their title. Documents without ancestors get an empty path.
    """
    w = _before(doc, pos)
    skip = F.lit(False) if skip is None else F.coalesce(skip, F.lit(False))
    parts = []
    for i in range(1, DEEPEST):
        mine = F.last(F.when(F.col(level) == i, F.struct(F.col(pos).alias("p"), F.when(~skip, F.col(text)).alias("t"))), True).over(w)
        above = F.max(F.when(F.col(level) < i, F.col(pos))).over(w)
        parts.append(F.when((F.col(level) > i) & (above.isNull() | (mine["p"] > above)), F.nullif(mine["t"], F.lit(""))))
    return blocks.withColumn(name, F.concat_ws(" > ", *parts))


def shift_levels(blocks: DataFrame, generic: Column, doc: str = "doc", pos: str = "pos", level: str = "level") -> DataFrame:
    """WN-02: generic headings removed, the others raised by their number of generic ancestors."""
    w = _before(doc, pos)
    marked = blocks.withColumn("_g", F.coalesce(generic, F.lit(False)))
    n = F.lit(0)
    for i in range(1, DEEPEST):
        nearest = F.last(F.when(F.col(level) <= i, F.struct(F.col(level).alias("l"), F.col("_g").alias("g"))), True).over(w)
        n = n + F.when((F.col(level) > i) & (nearest["l"] == i) & nearest["g"], 1).otherwise(0)
    return marked.withColumn("_n", n).filter(~F.col("_g")).withColumn("level_origin", F.col(level)).withColumn(level, F.greatest(F.lit(1), F.col(level) - F.col("_n"))).drop("_g", "_n")


def sections(blocks: DataFrame, head: Column, doc: str = "doc", pos: str = "pos", name: str = "section") -> DataFrame:
    """WN-03: sections opened by head rows. A document without any head is one section 0; rows
    before the first head of other documents drop out."""
    w = Window.partitionBy(doc)
    is_head = F.coalesce(head, F.lit(False)).cast("int")
    return blocks.withColumn(name, F.sum(is_head).over(w.orderBy(pos)).cast("int")).withColumn("_heads", F.sum(is_head).over(w)).filter((F.col(name) > 0) | (F.col("_heads") == 0)).drop("_heads")


def sub_sections(blocks: DataFrame, head: Column, doc: str = "doc", section: str = "section", pos: str = "pos", name: str = "sub") -> DataFrame:
    """WN-04: sections within sections; rows before the first sub-head drop out."""
    w = Window.partitionBy(doc, section).orderBy(pos)
    return blocks.withColumn(name, F.sum(F.coalesce(head, F.lit(False)).cast("int")).over(w).cast("int")).filter(F.col(name) > 0)


def inherit(blocks: DataFrame, decision: str, by: list[str], pos: str = "pos", name: str = "inherited") -> DataFrame:
    """WN-05: the first row's decision for every row of the section."""
    return blocks.withColumn(name, F.first(decision).over(Window.partitionBy(*by).orderBy(pos).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))


def body_runs(blocks: DataFrame, heading: Column, doc: str = "doc", pos: str = "pos", text: str = "text") -> DataFrame:
    """WN-06: body blocks since the last heading as one text, with the range of their positions.

    Blank bodies are left out; bodies before a document's first heading belong to none. The range
    ends at the last block in fact; range_dense is start + count - 1, as dense numbering has it.
    """
    w = Window.partitionBy(doc).orderBy(pos)
    is_head = F.coalesce(heading, F.lit(False))
    runs = blocks.withColumn("_h", F.sum(is_head.cast("int")).over(w)).withColumn("_title", F.last(F.when(is_head, F.col(text)), True).over(w))
    body = runs.filter((F.col("_h") > 0) & ~is_head & (F.trim(F.coalesce(text, F.lit(""))) != ""))
    grouped = body.groupBy(doc, "_h").agg(F.min(pos).alias("start"), F.max(pos).alias("stop"), F.count("*").alias("n"), F.first("_title").alias("title"), F.array_sort(F.collect_list(F.struct(pos, text))).alias("_b"))
    return grouped.select(
        doc, "title", "start", F.concat_ws("-", "start", "stop").alias("range"), F.concat_ws("-", F.col("start"), F.col("start") + F.col("n") - 1).alias("range_dense"),
        F.array_join(F.transform("_b", lambda b: b[text]), "\n").alias("content"),
    )


def first_children(blocks: DataFrame, k: int, doc: str = "doc", pos: str = "pos", level: str = "level", text: str = "text") -> DataFrame:
    """WN-07: the first k non-blank H2/H3 titles below each H1, in order."""
    w = Window.partitionBy(doc).orderBy(pos)
    held = blocks.withColumn("h1", F.sum((F.col(level) == 1).cast("int")).over(w)).filter((F.col("h1") > 0) & F.col(level).isin(2, 3) & (F.col(text) != ""))
    return held.withColumn("_r", F.row_number().over(Window.partitionBy(doc, "h1").orderBy(pos))).filter(F.col("_r") <= k).groupBy(doc, "h1").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_r", text))), lambda x: x[text]).alias("children")
    )


def doc_context(blocks: DataFrame, k: int = 10, doc: str = "doc", pos: str = "pos", level: str = "level", text: str = "text") -> DataFrame:
    """WN-08: the first k non-blank H1 titles of a document, or its H2 titles when it has no H1."""
    heads = blocks.filter(F.col(level).isin(1, 2) & (F.col(text) != ""))
    ranked = heads.withColumn("_r", F.row_number().over(Window.partitionBy(doc, level).orderBy(pos))).filter(F.col("_r") <= k)
    lists = ranked.groupBy(doc).agg(*[F.transform(F.array_sort(F.collect_list(F.when(F.col(level) == i, F.struct("_r", text)))), lambda x: x[text]).alias(f"h{i}") for i in (1, 2)])
    return lists.select(doc, F.when(F.size("h1") > 0, F.col("h1")).otherwise(F.col("h2")).alias("titles"))


def variant_counts(rows: DataFrame, source: str, title: str, name: str = "num_variants") -> DataFrame:
    """WN-09: number of non-empty titles of the row's source. Counts are aggregated first and joined,
    so a source with a third of the rows is no window of its own."""
    counts = rows.groupBy(F.col(source).alias("_s")).agg(F.count_if(F.coalesce(F.col(title), F.lit("")) != "").alias(name))
    return rows.join(counts, F.col(source).eqNullSafe(F.col("_s")), "left").drop("_s")


def explode_variants(rows: DataFrame, variants: Column, name: str = "variant") -> DataFrame:
    """WN-10: one row per variant with its ordinal from 1; rows without variants keep one, ordinal 0."""
    return rows.select("*", F.posexplode_outer(variants).alias("_p", name)).withColumn("variant_idx", F.coalesce(F.col("_p") + 1, F.lit(0))).drop("_p")


def range_texts(ranges: DataFrame, blocks: DataFrame, doc: str = "doc", span: str = "range", pos: str = "pos", text: str = "text") -> DataFrame:
    """JN-15: the text of "a-b" block ranges: ranges expand, join the blocks and fold in order."""
    from arborlake.functions.text import range_list

    wide = ranges.select(doc, span, F.explode(range_list(F.col(span))).alias("_p"))
    got = wide.join(blocks.select(F.col(doc).alias("_d"), F.col(pos).alias("_q"), F.col(text).alias("_t")), (F.col(doc) == F.col("_d")) & (F.col("_p") == F.col("_q")))
    return got.groupBy(doc, span).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_p", "_t"))), lambda x: x["_t"]), "\n").alias("text"))
