"""The decision table that stands in for external services, its fallbacks and adjudication.

decisions has task, key, ok, response (JSON text) and confidence. Operators join it where the
service would be asked; a missing or failed decision takes the documented fallback.
"""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborlake.operators.ranking import full_rank
from arborlake.runtime import lookup

# Statuses worth another attempt.
RETRYABLE = (408, 409, 425, 429)


@dataclass(frozen=True)
class Profile:
    """EX-01: settings of a decision source."""

    name: str = "table"
    provider: str = "table"
    model: str = ""
    timeout_s: int = 60
    retries: int = 3
    backoff: float = 1.5

    def resolve(self, override: Mapping | None = None, env: Mapping[str, str] | None = None) -> Profile:
        """Override over environment (DECISION_<NAME>) over the profile's own values."""
        env = os.environ if env is None else env
        out = self
        for field, kind in (("provider", str), ("model", str), ("timeout_s", int), ("retries", int), ("backoff", float)):
            value = (override or {}).get(field) or env.get(f"DECISION_{field.upper()}")
            if value not in (None, ""):
                out = replace(out, **{field: kind(value)})
        return out


def retry_delays(profile: Profile, statuses: list[int]) -> list[float]:
    """EX-02: waits before the attempts that follow failed ones; other statuses end the series."""
    out = []
    for n, status in enumerate(statuses[: profile.retries - 1], 1):
        if status not in RETRYABLE and status < 500:
            break
        out.append(profile.backoff ** (n - 1))
    return out


def parse_env(text: str) -> dict[str, str]:
    """HP-09: KEY=VALUE lines; comments, blank lines and quotes around values are dropped."""
    out = {}
    for line in text.splitlines():
        line = line.strip().removeprefix("export ")
        if line and not line.startswith("#") and "=" in line:
            k, v = line.split("=", 1)
            out[k.strip()] = v.strip().strip("\"'")
    return out


def prompt_hash(system: Column, user: Column) -> Column:
    """First 10 digits of the md5 of both prompts."""
    return F.substring(F.md5(F.concat(system, F.lit("\n"), user)), 1, 10)


def decide(rows: DataFrame, decisions: DataFrame, task: str, key: str, fallback: Column) -> DataFrame:
    """EX-02 at the point of use: rows with response, confidence and decided_by (decision, fallback).
    The last of several decisions by confidence and text counts."""
    d = decisions.filter((F.col("task") == task) & F.col("ok")).groupBy(F.col("key").alias("_k")).agg(F.max_by(F.struct("response", "confidence"), F.struct("confidence", "response")).alias("_d"))
    out = rows.join(d, F.col(key).cast("string") == F.col("_k"), "left")
    return out.withColumn("response", F.coalesce("_d.response", fallback)).withColumn("confidence", F.coalesce("_d.confidence", F.lit(0.0))).withColumn("decided_by", F.when(F.col("_d").isNull(), "fallback").otherwise("decision")).drop("_k", "_d")


def adjudicate(primary: Column, secondary: Column, evidence_primary: Column, evidence_secondary: Column, margin: float = 0.10) -> Column:
    """GR-09: agree, primary, conservative, primary_only, secondary_only or both_failed, from two
    canonical answers (null: failed) and the evidence for each (null: none)."""
    lead = F.coalesce(evidence_primary - evidence_secondary >= margin, F.lit(False))
    return (
        F.when(primary.isNull() & secondary.isNull(), "both_failed").when(secondary.isNull(), "primary_only").when(primary.isNull(), "secondary_only")
        .when(primary == secondary, "agree").when(lead, "primary").otherwise("conservative")
    )


def assign_categories(heads: DataFrame, decisions: DataFrame, categories: DataFrame, rounds: tuple[str, ...] = ("round1", "round2", "round3"), discard: str = "DISCARD") -> DataFrame:
    """GR-10: head_id, category and round of the first round that decides a head; a decision for a
    category outside the list creates it, discard drops the head, none leaves Unknown_Cluster.

    One join on all rounds' decisions, not one pass per round.
    """
    order = F.array_position(F.array(*map(F.lit, rounds)), F.col("task"))
    d = decisions.filter(F.col("ok") & F.col("task").isin(*rounds)).groupBy(F.col("key").alias("_k")).agg(F.min_by(F.struct("response", order.alias("r")), F.struct(order.alias("r"), "response")).alias("_d"))
    out = heads.join(d, F.col("head_id").cast("string") == F.col("_k"), "left").filter(~F.coalesce(F.col("_d.response") == discard, F.lit(False)))
    known = categories.select(F.col("name").alias("_c"), F.col("id").alias("_id"))
    new = lambda n: F.concat(F.lit("L1_N"), F.substring(F.md5(n), 1, 8))
    name = F.coalesce(F.col("_d.response"), F.lit("Unknown_Cluster"))
    return out.withColumn("category", name).join(known, F.col("category") == F.col("_c"), "left").select("head_id", "category", F.coalesce("_id", new(F.col("category"))).alias("category_id"), F.coalesce("_d.r", F.lit(0)).cast("int").alias("round"))


def clean_titles(response: Column, max_new: int = 3) -> Column:
    """EX-07: unique trimmed non-empty strings of a JSON list, the first max_new."""
    items = F.coalesce(F.from_json(response, "array<string>"), F.array().cast("array<string>"))
    return F.slice(F.array_distinct(F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x != "")), 1, max_new)


def granularity_decision(response: Column) -> Column:
    """EX-08: struct(granularity, confidence): the enumeration checked (else meso), confidence held to
    0..1, 0 and missing ones .5; a failed response is meso at .4."""
    r = F.from_json(response, "granularity string, confidence double")
    g = F.lower(F.trim(r["granularity"]))
    conf = F.when(r["confidence"].isNull() | (r["confidence"] == 0), 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), r["confidence"])))
    bad = response.isNull() | (g.isNull() & r["confidence"].isNull())
    return F.struct(F.when(g.isin("macro", "meso", "micro"), g).otherwise("meso").alias("granularity"), F.when(bad, 0.4).otherwise(conf).alias("confidence"))


def extract_units(responses: DataFrame, doc: str = "doc_id", block: str = "block", response: str = "response") -> DataFrame:
    """EX-06: one row per unit of a response list, its id T5_{doc}_{block}_{n}."""
    from arborlake.functions.text import padded

    u = responses.select(doc, block, F.posexplode(F.from_json(response, "array<string>")).alias("_p", "unit")).filter("trim(unit) <> ''")
    n = F.row_number().over(Window.partitionBy(doc, block).orderBy("_p"))
    return u.withColumn("_n", n).select(F.concat_ws("_", F.lit("T5"), F.split_part(F.col(doc).cast("string"), F.lit("."), F.lit(1)), padded(F.col(block), 5), padded(F.col("_n"), 2)).alias("unit_id"), doc, block, "unit")


def hashed_vectors(rows: DataFrame, key: str, text: str, dim: int = 64) -> DataFrame:
    """EX-03: a vector provider without a network: hashed token counts, length one."""
    from arborlake.functions.text import tokens
    from arborlake.operators.similarity import l2_normalize

    t = rows.select(key, F.explode_outer(tokens(F.col(text))).alias("_t")).groupBy(key, F.pmod(F.xxhash64("_t"), F.lit(dim)).cast("int").alias("_b")).agg(F.count("_t").alias("_n"))
    m = t.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("_b", F.col("_n").cast("double")))).alias("_m"))
    return m.select(key, l2_normalize(F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.try_element_at("_m", i), F.lit(0.0)))).alias("v"))


def overlap_scores(pairs: DataFrame, texts: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """EX-04: a rerank provider without a network: token overlap of both ends; a missing text scores 0."""
    from arborlake.functions.text import jaccard, tokens

    t = texts.select(F.col(key).alias("_i"), tokens(F.col(text)).alias("_t"))
    a = lookup(pairs, t.select(F.col("_i").alias("_ia"), F.col("_t").alias("_a")), "id_a", "_ia", "id_b", "left").drop("_ia")
    a = lookup(a, t.select(F.col("_i").alias("_ib"), F.col("_t").alias("_b")), "id_b", "_ib", "id_a", "left").drop("_ib")
    empty = F.array().cast("array<string>")
    return a.withColumn("rerank_score", jaccard(F.coalesce("_a", empty), F.coalesce("_b", empty))).drop("_a", "_b")


#: Documents a rerank request holds, at most.
CHUNK = 20


def rerank_requests(pairs: DataFrame, size: int = CHUNK) -> DataFrame:
    """EX-04: (id_a, chunk, documents) requests of distinct pairs (id_a, id_b): the partners in order,
    size a request, so an id with any number of partners is many requests."""
    ranked = full_rank(pairs.select("id_a", "id_b").distinct(), "id_a", [F.asc("id_b")], "_r")
    parts = ranked.groupBy("id_a", F.expr(f"cast((_r - 1) div {size} as int)").alias("chunk"))
    return parts.agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "id_b"))), lambda x: x["id_b"]).alias("documents"))


def rerank_scores(response: Column, n: Column) -> Column:
    """EX-04: scores of n documents from a provider's JSON. The list is results, data or
    output.results; items with an index go there (the last of several), a document without one has 0;
    items without any index go by position: objects, (id, score) pairs or plain numbers. Text that is
    no such JSON gives null: the request failed."""
    r = F.from_json(response, "results array<string>, data array<string>, output struct<results array<string>>")
    items = F.coalesce(r["results"], r["data"], r["output"]["results"])
    score = lambda x: F.coalesce(F.get_json_object(x, "$.relevance_score").try_cast("double"), F.get_json_object(x, "$.score").try_cast("double"), F.get_json_object(x, "$[1]").try_cast("double"), x.try_cast("double"), F.lit(0.0))
    index = lambda x: F.get_json_object(x, "$.index").try_cast("int")
    placed = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.coalesce(F.try_element_at(F.transform(F.filter(items, lambda x: index(x) == i), score), F.lit(-1)), F.lit(0.0)))
    in_order = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.coalesce(F.get(F.transform(items, score), i), F.lit(0.0)))
    return F.when(items.isNull(), None).when(n < 1, F.array().cast("array<double>")).when(F.exists(items, lambda x: F.coalesce(index(x).isNotNull(), F.lit(False))), placed).otherwise(in_order)


def rerank_results(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """EX-04: (id_a, id_b, rerank_score) of requests and their responses (id_a, chunk, response); null
    where a request failed or has no response."""
    j = requests.join(responses.select("id_a", "chunk", "response"), ["id_a", "chunk"], "left").withColumn("_s", rerank_scores(F.col("response"), F.size("documents")))
    rows = j.select("id_a", "_s", F.posexplode("documents").alias("_p", "id_b"))
    return rows.select("id_a", "id_b", F.get("_s", F.col("_p")).alias("rerank_score"))


def resume(samples: DataFrame, scores: DataFrame, decisions: DataFrame, task: str, key: str = "sample_id") -> DataFrame:
    """EX-05: decisions of the samples that have no score yet."""
    pending = samples.select(key).distinct().join(scores.select(key).distinct(), key, "left_anti")
    return decide(pending, decisions, task, key, F.lit(None).cast("string")).filter("decided_by = 'decision'").select(key, "response", "confidence")


#: EX-09: fields of an edit event.
EVENT_SCHEMA = "seq long, step string, op string, node_id string, parent string, child string, winner string, loser string, label string, reason string"
