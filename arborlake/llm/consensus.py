"""P4: consensus of several annotators by the triplet moment method.

Agreement rates of every pair of raters, corrected for the agreement their own marginals give by
chance, are products of the two raters' truth-tracking rates; each triplet (i, j, k) therefore gives
one estimate of rater i, and the weighted median over all (j, k) withstands raters who copy each
other. Rates become log-odds weights, and the consensus is the score with the largest sum of them.

Pairs of ratings are never emitted: each partition multiplies its one-hot rating matrix with itself
and sends raters x raters sums, whatever the number of items.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlake.runtime import Stage, require_columns

#: Raters are columns of the rating matrices; their number does not grow with the items. Triplets of
#: so many raters are some millions per dimension, solved by the driver in seconds.
MAX_RATERS = 256
#: A rater is reported as careful in a dimension when it tracks the truth at least this often beyond
#: chance; the vote does not depend on it.
CAREFUL = 0.5


def newest_ratings(scores: DataFrame, item: str, rater: str, dims: dict[str, str], order: str, low: int = 1, high: int = 5) -> DataFrame:
    """(item, rater, <dims>) of the newest row of every item and rater; other values than low..high
    are null. dims maps a dimension to its expression. Rows without item or rater drop out; equal
    times: the larger ratings count, so copies change nothing."""
    require_columns(scores, (item, rater, order), "ratings")
    values = F.struct(*[F.expr(e).alias(k) for k, e in dims.items()])
    newest = (
        scores.filter(F.col(item).isNotNull() & F.col(rater).isNotNull())
        .select(F.col(item).alias("item"), F.col(rater).alias("rater"), values.alias("v"), F.col(order).alias("at"))
        .groupBy("item", "rater").agg(F.max_by("v", F.struct("at", "v")).alias("v"))
    )
    return newest.select("item", "rater", *[F.when(F.col(f"v.{k}").between(low, high), F.col(f"v.{k}")).cast("int").alias(k) for k in dims])


def _lists(ratings: DataFrame, dims: Sequence[str]) -> DataFrame:
    """One row per item with its ratings; at most one per rater, so the lists are short."""
    return ratings.groupBy("item").agg(F.collect_list(F.struct("rater", *dims)).alias("r"))


def _flat(batch: pa.RecordBatch, raters: dict[str, int], dims: Sequence[str]):
    lists = batch.column("r")
    rows, values = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy())), lists.flatten()
    who = np.array([raters[x] for x in values.field("rater").to_pylist()], dtype=np.int64)
    return rows, who, [values.field(d).fill_null(0).to_numpy(zero_copy_only=False) for d in dims]


def pair_agreement(lists: DataFrame, raters: list[str], dims: Sequence[str], low: int = 1, high: int = 5) -> dict[str, dict[str, np.ndarray]]:
    """Per dimension: both (items both rated), same (equal ratings), marginal (rater x score)."""
    if len(raters) > MAX_RATERS:
        raise ValueError(f"{len(raters)} raters; at most {MAX_RATERS}")
    index, k = {r: i for i, r in enumerate(raters)}, len(raters)
    width = high - low + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {(d, v): np.zeros((k, k)) for d in dims for v in range(low - 1, high + 1)}
        for batch in batches:
            n = batch.num_rows
            rows, who, columns = _flat(batch, index, dims)
            for d, col in zip(dims, columns):
                for start in range(0, n, 2048):  # the matrix of a slice of items, not of the batch
                    here = (rows >= start) & (rows < start + 2048)
                    rated = np.zeros((2048, k), np.float32)
                    for v in range(low, high + 1):
                        at = here & (col == v)
                        x = np.zeros((2048, k), np.float32)
                        x[rows[at] - start, who[at]] = 1
                        rated += x
                        sums[d, v] += x.T @ x
                    sums[d, low - 1] += rated.T @ rated
        d, v, m = zip(*[(d, v, m.ravel().tolist()) for (d, v), m in sums.items()])
        yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(v, pa.int32()), pa.array(m, pa.list_(pa.float64()))], names=["d", "v", "m"])

    parts = lists.select("r").mapInArrow(run, "d string, v int, m array<double>")
    summed = parts.select("d", "v", F.posexplode("m").alias("p", "x")).groupBy("d", "v", "p").agg(F.sum("x").alias("x"))
    whole = summed.groupBy("d", "v").agg(F.array_sort(F.collect_list(F.struct("p", "x"))).alias("m")).collect()  # raters squared values each
    got = {(r.d, r.v): np.array([x.x for x in r.m]).reshape(k, k) for r in whole}
    empty = np.zeros((k, k))
    return {
        d: {
            "both": got.get((d, low - 1), empty),
            "same": sum((got.get((d, v), empty) for v in range(low, high + 1)), empty),
            "marginal": np.stack([np.diag(got.get((d, v), empty)) for v in range(low, high + 1)], 1) if k else np.zeros((0, width)),
        }
        for d in dims
    }


def _weighted_median(x: np.ndarray, w: np.ndarray) -> float:
    at = np.argsort(x)
    c = np.cumsum(w[at])
    return float(x[at][np.searchsorted(c, c[-1] / 2)])


def triplet_rates(both: np.ndarray, same: np.ndarray, marginal: np.ndarray, least_items: int = 20) -> np.ndarray:
    """Truth-tracking rate of every rater in 0..1, NaN where no triplet has enough common items."""
    k = len(both)
    share = marginal / np.maximum(marginal.sum(1, keepdims=True), 1)
    pooled = marginal.sum(0) / max(marginal.sum(), 1)
    spread = max(1 - float((pooled**2).sum()), 1e-9)
    enough = both >= least_items
    np.fill_diagonal(enough, False)
    c = np.where(enough, (same / np.maximum(both, 1) - share @ share.T) / spread, np.nan)
    out = np.full(k, np.nan)
    for i in range(k):
        j, m = np.triu_indices(k, 1)
        ok = (j != i) & (m != i) & enough[i, j] & enough[i, m] & enough[j, m]
        j, m = j[ok], m[ok]
        base = c[j, m]
        use = base > 0.02
        if use.any():
            # a rater that agrees below chance with others does not track the truth
            first, second = c[i, j[use]], c[i, m[use]]
            q2 = np.where((first > 0) & (second > 0), first * second, 0) / base[use]
            out[i] = min(1.0, max(0.0, _weighted_median(q2, base[use]))) ** 0.5
    return out


def reliability(ratings: DataFrame, dims: Sequence[str], low: int = 1, high: int = 5, careful: float = CAREFUL, stage: Stage | None = None):
    """(per-item lists, table of rater reliability) where the table has one row per rater and
    dimension: dimension, rater, n_ratings, rate (truth tracking), accuracy, weight, careful."""
    stage = stage or Stage(ratings.sparkSession, "consensus")
    lists = stage.save(_lists(ratings, dims))
    raters = sorted(r[0] for r in lists.select(F.explode("r.rater").alias("x")).distinct().limit(MAX_RATERS + 1).collect())
    stats, rows = pair_agreement(lists, raters, dims, low, high), []
    width = high - low + 1
    for d in dims:
        q = triplet_rates(**stats[d])
        for i, r in enumerate(raters):
            rate = None if np.isnan(q[i]) else float(q[i])
            acc = None if rate is None else min(max(rate + (1 - rate) / width, 1e-3), 1 - 1e-3)
            weight = 0.0 if acc is None else float(np.log(acc * (width - 1) / (1 - acc)))
            rows.append((d, r, int(stats[d]["marginal"][i].sum()), rate, acc, max(weight, 0.0), rate is not None and rate >= careful))
    return lists, rows


RELIABILITY = "dimension string, rater string, n_ratings long, rate double, accuracy double, weight double, careful boolean"


def consensus(ratings: DataFrame, dims: Sequence[str], low: int = 1, high: int = 5, careful: float = CAREFUL) -> tuple[DataFrame, DataFrame]:
    """(consensus table, reliability table) of ratings (item, rater, <dims>; null: not rated).

    Consensus: item, dimension, consensus, support (share of the weights that gives it), n_votes
    (raters with a weight). Raters vote with their log-odds weights; an item whose raters have none is
    decided by plain numbers. Equal sums go to the score with more raters, then to the smaller one.
    An item that nobody rated in a dimension has no row there. Empty in, empty out.
    """
    spark = ratings.sparkSession
    lists, rows = reliability(ratings, dims, low, high, careful)
    table = spark.createDataFrame(rows, RELIABILITY)
    index = {r: i for i, r in enumerate(sorted({x[1] for x in rows}))}
    weight = np.zeros((len(dims), max(len(index), 1)))
    for d, r, _, _, _, w, _ in rows:
        weight[list(dims).index(d), index[r]] = w
    names = list(dims)
    kind = lists.schema["item"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = high - low + 1
        for batch in batches:
            n = batch.num_rows
            at, who, columns = _flat(batch, index, names)
            for x, (d, col) in enumerate(zip(names, columns)):
                rated = col > 0
                cell = at[rated] * width + (col[rated] - low)
                w = weight[x][who[rated]]
                total = lambda v: np.bincount(cell, v, n * width).reshape(n, width)  # noqa: E731, B023
                logs, plain, some = total(w), total(np.ones(len(w))), total((w > 0).astype(float)).sum(1)
                none = some == 0
                logs[none], some[none] = plain[none], plain[none].sum(1)
                best = np.lexsort((-np.arange(width) + np.zeros((n, 1)), plain, np.round(logs, 9)), axis=1)[:, -1]
                hit, rated_at_all = logs[np.arange(n), best], plain.sum(1) > 0
                yield pa.RecordBatch.from_arrays(
                    [batch.column("item").filter(pa.array(rated_at_all)), pa.array([d] * int(rated_at_all.sum()), pa.string()), pa.array((best + low)[rated_at_all], pa.int32()),
                     pa.array((hit / np.maximum(logs.sum(1), 1e-12))[rated_at_all]), pa.array(some[rated_at_all].astype(np.int32))],
                    names=["item", "dimension", "consensus", "support", "n_votes"])

    return lists.mapInArrow(run, f"item {kind}, dimension string, consensus int, support double, n_votes int"), table


def ordinal_alpha(ratings: DataFrame, dims: Sequence[str], low: int = 1, high: int = 5) -> DataFrame:
    """Krippendorff's alpha with the ordinal metric per dimension: dimension, n_items, alpha.

    From the coincidences of values within items rated at least twice; null when all such ratings
    are equal or there are none. One row per item is the most that is shuffled.
    """
    long = ratings.select("item", F.explode(F.create_map(*[x for d in dims for x in (F.lit(d), F.col(d))])).alias("dimension", "value")).filter("value is not null")
    values = range(low, high + 1)
    per = long.groupBy("dimension", "item").agg(*[F.count_if(F.col("value") == v).alias(f"c{v}") for v in values], F.count("*").alias("n")).filter("n > 1")
    pairs = [(a, b) for a in values for b in values if a < b]
    sums = per.groupBy("dimension").agg(
        F.count("*").alias("n_items"), F.sum("n").alias("total"), *[F.sum(f"c{v}").alias(f"t{v}") for v in values],
        *[F.sum(2.0 * F.col(f"c{a}") * F.col(f"c{b}") / (F.col("n") - 1)).alias(f"o{a}{b}") for a, b in pairs],
    )
    gap = lambda a, b: F.pow(sum(F.col(f"t{g}") for g in range(a, b + 1)) - (F.col(f"t{a}") + F.col(f"t{b}")) / 2, 2.0)
    seen = sum(F.col(f"o{a}{b}") * gap(a, b) for a, b in pairs)
    chance = sum(2.0 * F.col(f"t{a}") * F.col(f"t{b}") * gap(a, b) for a, b in pairs)
    return sums.select("dimension", "n_items", F.when(chance > 0, 1 - (F.col("total") - 1) * seen / chance).alias("alpha"))
