"""P8: records of several sources mixed to target shares of the total size, by entropy balancing.

Among all rates that meet the size constraints, entropy balancing takes those nearest to one copy of
every record; they are exponential in the record's size with one dual value per source. The convex
dual is solved by Newton steps. A rate depends on source and size alone, so their sums (size, size
squared under the current rates) run over the table of records per source and size, one aggregation
per step. Rates become whole copies by a threshold on each record's hash, set by prefix sums so that
every source's copies sum to its size.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborlake.runtime import Stage, require_columns

#: Buckets of the fractional threshold per refinement; two refinements leave 1 part in 16 million.
BUCKETS = 4096
#: Target tables list sources; their number is bounded, since each costs a few driver-side numbers and
#: a row of the parameters that joins broadcast.
MAX_SOURCES = 10_000


def canonical_source(col: Column | str) -> Column:
    """One spelling per source: lower case, trimmed, with _ for hyphens and blanks; null stays null."""
    c = F.col(col) if isinstance(col, str) else col
    return F.regexp_replace(F.lower(F.trim(c)), r"[\s\-]+", "_")


def plan_shares(sizes: dict[str, tuple[float, int]], targets: dict[str, tuple[float, int]], total: float | None = None) -> dict[str, dict]:
    """Per target source: share asked, share to reach and size to reach.

    sizes: {source: (size, records)}; targets: {source: (share, max_repeats)}. Sources without any
    size cannot contribute; their share is spread over the others in proportion. total None takes the
    largest total at which every source reaches its share within its repeats; a given total that is
    larger leaves sources short, each at its cap.
    """
    able = {s: (w, cap) for s, (w, cap) in targets.items() if w > 0 and cap > 0 and sizes.get(s, (0, 0))[0] > 0}
    whole = sum(w for w, _ in able.values())
    if total is None:
        total = min((cap * sizes[s][0] * whole / w for s, (w, cap) in able.items()), default=0.0)
    out = {}
    for s, (w, cap) in targets.items():
        share = w / whole if s in able else 0.0
        limit = cap * sizes.get(s, (0.0, 0))[0] if s in able else 0.0
        out[s] = {"asked": w, "share": share, "goal": min(share * total, limit), "cap": cap, "size": sizes.get(s, (0.0, 0))[0]}
    return out


def balance(records: DataFrame, targets: DataFrame, total: float | None = None, key: str = "key", steps: int = 60, tolerance: float = 1e-7) -> tuple[DataFrame, list[dict]]:
    """(copies, report) of records (key, source, size) under targets (source, target_share, max_repeats).

    copies: key, source, size, rate, copies of every record, 0 for those of sources without a target,
    of null sources and of a size that is null, 0 or not finite. report: one dict per target source
    with the share asked, the share aimed at, the size aimed at, the size reached, and whether the
    dual converged within the steps. Repeated keys are records of their own unless all columns are
    equal; repeated target rows: the largest share counts. Deterministic: the same records give the
    same copies in any order and partitioning.
    """
    require_columns(records, (key, "source", "size"), "records")
    require_columns(targets, ("source", "target_share", "max_repeats"), "targets")
    spark = records.sparkSession
    stage = Stage(spark, "mixing")
    asked_rows = targets.filter("source is not null and target_share is not null").groupBy(canonical_source("source").alias("source")).agg(F.max("target_share").alias("w"), F.max("max_repeats").alias("cap")).limit(MAX_SOURCES + 1).collect()
    if len(asked_rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} target sources")
    asked = {r.source: (float(r.w), int(r.cap or 0)) for r in asked_rows}

    def parameters(rows: list[tuple], schema: str) -> DataFrame:
        return F.broadcast(spark.createDataFrame(rows, ", ".join(filter(None, ("source string", schema)))))  # a row per source

    size = F.col("size").cast("double")
    rows = stage.save(records.select(key, canonical_source("source").alias("source"), F.when((size > 0) & (size < math.inf), size).otherwise(0.0).alias("size")))
    by_size = stage.save(rows.filter("size > 0").join(parameters([(s,) for s in asked], ""), "source", "left_semi").groupBy("source", "size").agg(F.count("*").alias("n"))) if asked else None
    sizes = {r.source: (r.s, r.n) for r in by_size.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("s"), F.sum("n").alias("n")).collect()} if asked else {}
    plan = plan_shares(sizes, asked, total)

    # Newton on the dual: rate = min(cap, exp(dual * size / mean size))
    mean = {s: v[0] / v[1] for s, v in sizes.items()}
    dual: dict[str, float] = {}
    low, high = {}, {}
    full = set()
    for s in sizes:
        if plan[s]["goal"] <= 0:
            continue
        if plan[s]["goal"] >= plan[s]["cap"] * sizes[s][0] * (1 - 1e-9):
            full.add(s)
            continue
        dual[s] = max(-3.0, min(3.0, math.log(plan[s]["goal"] / sizes[s][0])))
        low[s], high[s] = -60.0 * max(1.0, mean[s]), 60.0 * max(1.0, mean[s])

    tilt = F.least(F.col("cap"), F.exp(F.least(F.lit(50.0), F.col("slope") * F.col("size"))))
    open_ = set(dual)
    for _ in range(steps):
        if not open_:
            break
        now = parameters([(s, dual[s] / mean[s], float(plan[s]["cap"])) for s in open_], "slope double, cap double")
        weighed = by_size.join(now, "source").withColumn("rate", tilt).withColumn("w", F.col("n") * F.col("size") * F.col("rate"))
        sums = weighed.groupBy("source").agg(F.sum("w").alias("f"), F.sum(F.when(F.col("rate") < F.col("cap"), F.col("w") * F.col("size"))).alias("h")).collect()
        for x in sums:
            s, gap = x.source, x.f - plan[x.source]["goal"]
            if abs(gap) <= tolerance * plan[s]["goal"]:
                open_.discard(s)
                continue
            if gap > 0:
                high[s] = min(high[s], dual[s])
            else:
                low[s] = max(low[s], dual[s])
            step = gap * mean[s] / x.h if x.h else math.inf
            new = dual[s] - max(-4.0, min(4.0, step))
            if not low[s] < new < high[s] or not math.isfinite(step):
                new = (low[s] + high[s]) / 2  # Newton left the bracket: halve it
            dual[s] = round(new, 9)  # sums differ in their last bits from run to run

    # whole copies: floor of the rate, and one more where hash minus fraction is below the source's limit
    def rated(df: DataFrame, limit: dict[str, tuple[float, float]]) -> DataFrame:
        known = parameters(
            [(s, dual[s] / mean[s] if s in dual else None, float(plan[s]["cap"]), *limit.get(s, (None, None))) for s in (*dual, *full)],
            "slope double, cap double, least double, span double",
        )
        joined = df.join(known, "source", "left")
        rate = F.when((F.col("size") > 0) & F.col("cap").isNotNull(), F.when(F.col("slope").isNull(), F.col("cap")).otherwise(tilt)).otherwise(0.0)
        return joined.withColumn("rate", rate).withColumn("base", F.floor("rate").cast("int"))

    hashed = F.pmod(F.xxhash64(F.col(key)), F.lit(1 << 40)) / float(1 << 40)
    at = F.when((F.col("base") < F.col("cap")) & (F.col("rate") > F.col("base")), hashed - (F.col("rate") - F.col("base")))
    below = {s: 0.0 for s in dual}
    limit = {s: (-1.0, 2.0) for s in dual}
    if dual:
        held = rated(by_size, {}).groupBy("source").agg(F.sum(F.col("base") * F.col("size") * F.col("n")).alias("s")).collect()
        below |= {r.source: r.s or 0.0 for r in held if r.source in dual}
    for turn in range(2):
        if not dual:
            break
        goals = parameters([(s, plan[s]["goal"] - below[s]) for s in dual], "room double")
        bins = rated(rows, limit).withColumn("bin", F.floor((at - F.col("least")) / F.col("span") * BUCKETS).cast("int")).filter((F.col("bin") >= 0) & (F.col("bin") < BUCKETS))
        held = bins.groupBy("source", "bin").agg(F.sum("size").alias("s"))  # BUCKETS rows a source at most
        upto = held.withColumn("upto", F.sum("s").over(Window.partitionBy("source").orderBy("bin"))).join(goals, "source")
        over = F.col("upto") > F.col("room")
        cuts = upto.groupBy("source").agg(F.min(F.when(over, F.col("bin"))).alias("cut"), F.min(F.when(over, F.col("upto") - F.col("room"))).alias("over"), F.max(F.when(~over, F.col("upto"))).alias("under")).collect()
        found = {r.source: r for r in cuts}
        for s in dual:
            r = found.get(s)
            under = (r.under or 0.0) if r else 0.0
            room = plan[s]["goal"] - below[s] - under
            cut = BUCKETS if r is None or r.cut is None else r.cut
            if turn == 1 and r is not None and r.cut is not None and r.over < room:
                cut += 1  # the last bucket counts when that ends nearer to the goal
            below[s] += under
            least, span = limit[s]
            limit[s] = (least + span * cut / BUCKETS, span / BUCKETS)
    more = F.coalesce((at < F.col("least")).cast("int"), F.lit(0))
    copies = rated(rows, limit).withColumn("copies", F.coalesce(F.col("base") + more, F.lit(0)).cast("int"))
    copies = stage.save(copies.select(key, "source", "size", "rate", "copies"))
    reached = {r.source: (r.s, r.n, r.u, r.m) for r in copies.filter("copies > 0").groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("s"), F.sum("copies").alias("n"), F.count("*").alias("u"), F.max("copies").alias("m")).collect()}
    everything = sum(v[0] for v in reached.values())
    report = []
    for s, p in sorted(plan.items()):
        size, n, distinct, most = reached.get(s, (0.0, 0, 0, 0))
        report.append({"source": s, "target_share": p["asked"], "planned_share": p["share"], "actual_share": size / everything if everything else 0.0, "size": int(p["size"]), "mixed_size": int(size), "n_copies": int(n), "n_records": int(distinct), "most_copies": int(most), "max_repeats": p["cap"], "converged": s not in open_})
    return copies, report


REPORT = "source string, target_share double, planned_share double, actual_share double, size long, mixed_size long, n_copies long, n_records long, most_copies int, max_repeats int, converged boolean"
