"""Queries pN_... of the training-data operators; their SQL twins are in arborlake.llm.sql."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlake.llm import components, consensus, mixing, neighbors, pairs, reading, tokenize, visible
from arborlake.llm.sql import SQL  # noqa: F401
from arborlake.runtime import Stage, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


# P3 -----------------------------------------------------------------------------------------------


@_query
def p3_found(spark, d):
    """Nodes whose label and human label differ as stored, are equal in their comparison form and, by
    the exact check of what a reader sees, look the same."""
    nodes = visible.unify_labels(table(spark, d, "tree_nodes_l3"))
    return nodes.filter("label <> human_label and label_form = human_label_form and label_seen = human_label_seen").select("node_id")


@_query
def p3_labels(spark, d):
    """Both labels of every node in their comparison form, with what a reader sees of the change:
    style is a difference of case, raised or circled characters and the like only."""
    nodes = visible.unify_labels(table(spark, d, "tree_nodes_l3"))
    change = (
        F.when(F.col("label").isNull() | F.col("human_label").isNull(), "missing")
        .when(F.col("label") == F.col("human_label"), "none")
        .when(F.col("label_seen") == F.col("human_label_seen"), "encoding")
        .when(F.col("label_form") == F.col("human_label_form"), "style")
        .otherwise("renamed")
    )
    return nodes.select("node_id", "label_form", "human_label_form", change.alias("change"))


# P5 -----------------------------------------------------------------------------------------------


@_query
def p5_found(spark, d):
    """Group id of every sample linked by a score of at least 0.55."""
    pairs = components.linked_pairs(table(spark, d, "policy_similarity_rerank_edges"), 0.55)
    return components.connected_groups(pairs).select(F.col("node").alias("sample_id"), "group_id")


@_query
def p5_group_sizes(spark, d):
    """Number of groups per size."""
    pairs = components.linked_pairs(table(spark, d, "policy_similarity_rerank_edges"), 0.55)
    sizes = components.connected_groups(pairs).groupBy("group_id").agg(F.count("*").alias("group_size"))
    return sizes.groupBy("group_size").agg(F.count("*").alias("n_groups"))


# P7 -----------------------------------------------------------------------------------------------


@_query
def p7_ids(spark, d):
    """Ids of every document by byte_bpe_50k; an empty list for null and empty texts."""
    return tokenize.encode_texts(table(spark, d, "documents"), "doc_id").select("doc_id", "ids")


@_query
def p7_token_counts(spark, d):
    """Documents, tokens and longest document per language tag."""
    docs = table(spark, d, "documents")
    counts = tokenize.encode_texts(docs, "doc_id", ids=False)
    return docs.select("doc_id", "lang").join(counts, "doc_id").groupBy("lang").agg(
        F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.max("n_tokens").alias("longest")
    )


@_query
def p7_round_trip(spark, d):
    """Decoded text of every document beside its id: equals the text, '' for null."""
    ids = tokenize.encode_texts(table(spark, d, "documents"), "doc_id")
    return tokenize.decode_ids(ids, "doc_id").select("doc_id", F.md5("text").alias("text_md5"))


# P4 -----------------------------------------------------------------------------------------------

_DIMS = ("vertical_coherence", "horizontal_coherence", "label_quality")


def _ratings(spark, d):
    return consensus.newest_ratings(table(spark, d, "node_scores"), "sample_id", "judge_key", {x: f"result.scores.{x}" for x in _DIMS}, "scored_at")


@_query
def p4_found(spark, d):
    """Consensus score of every judged sample and dimension."""
    found, _ = consensus.consensus(_ratings(spark, d), _DIMS)
    return found.select(F.col("item").alias("sample_id"), "dimension", "consensus")


@_query
def p4_judges(spark, d):
    """Reliability of every judge in every dimension."""
    _, judges = consensus.consensus(_ratings(spark, d), _DIMS)
    return judges.withColumnRenamed("rater", "judge_key")


@_query
def p4_alpha(spark, d):
    """Krippendorff's ordinal alpha of each dimension."""
    return consensus.ordinal_alpha(_ratings(spark, d), _DIMS).select("dimension", "n_items", F.round("alpha", 6).alias("alpha"))


# P1 -----------------------------------------------------------------------------------------------


@_query
def p1_found(spark, d):
    """Defective responses with their defect type."""
    return pairs.flag_pairs(table(spark, d, "llm_balance_log"), "response_id", "prompt", "resp.raw", "ts").select("response_id", "defect")


@_query
def p1_by_task(spark, d):
    """Defects per task, beside what the log's own flag says of them."""
    log = table(spark, d, "llm_balance_log")
    newest = log.filter("response_id is not null").groupBy("response_id").agg(F.max_by(F.struct("task", "resp.ok"), F.struct("ts", "resp.raw", "task")).alias("x"))
    found = pairs.flag_pairs(log, "response_id", "prompt", "resp.raw", "ts")
    return found.join(newest, "response_id").groupBy(F.col("x.task").alias("task"), "defect").agg(
        F.count("*").alias("n_pairs"), F.count_if("x.ok").alias("n_marked_ok")
    )


# P2 -----------------------------------------------------------------------------------------------

_DIM = 64


def _corpus(spark, d):
    return neighbors.usable_vectors(table(spark, d, "policy_corpus_embeddings"), "sample_id", "vector", "embedding", "loaded_at", _DIM)


@_query
def p2_found(spark, d):
    """Pairs of a probe and one of its 10 most similar samples."""
    stage = Stage(spark, "p2")
    corpus, seen = stage.save(_corpus(spark, d), {"n": F.count(F.lit(1))})
    probes = corpus.join(table(spark, d, "knn_probes").select(F.col("sample_id").alias("id")).distinct(), "id", "left_semi")
    near = neighbors.knn(corpus, probes, _DIM, stage=stage, total=seen["n"])
    return near.select(F.least("query_id", "id").alias("id_a"), F.greatest("query_id", "id").alias("id_b")).distinct()


@_query
def p2_exact(spark, d):
    """Exact search (factor 1) over the embeddings table; queries are the ids divisible by 20."""
    rows = neighbors.unit_vectors(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), _DIM)
    near = neighbors.knn(rows, rows.filter("id % 20 = 0"), _DIM, factor=1.0, shard_rows=512, leaf_rows=32)
    return near.select("query_id", "rank", "id")


# P9 -----------------------------------------------------------------------------------------------


@_query
def p9_found(spark, d):
    """Reading band of every document with a text."""
    return reading.reading_bands(table(spark, d, "documents"), table(spark, d, "reading_examples")).select("doc_id", "reading_band")


@_query
def p9_profile(spark, d):
    """Documents and mean level per source spelling and band."""
    docs = table(spark, d, "documents")
    bands = reading.reading_bands(docs, table(spark, d, "reading_examples"))
    return docs.select("doc_id", "source").join(bands, "doc_id").groupBy("source", "reading_band").agg(F.count("*").alias("n_docs"), F.round(F.avg("level"), 3).alias("mean_level"))


# P8 -----------------------------------------------------------------------------------------------


def _mix(spark, d):
    docs = table(spark, d, "documents")
    sizes = tokenize.encode_texts(docs.select(F.struct("doc_id", "source").alias("k"), "text"), "k", ids=False)
    records = sizes.select(F.col("k.doc_id").alias("doc_id"), F.col("k.source").alias("source"), F.col("n_tokens").alias("size"))
    return mixing.balance(records, table(spark, d, "mix_targets"), key="doc_id")


@_query
def p8_mix(spark, d):
    """Copies of every document in the mix, with its size in tokens of byte_bpe_50k."""
    copies, _ = _mix(spark, d)
    return copies.select("doc_id", "source", F.col("size").cast("long").alias("n_tokens"), "copies")


@_query
def p8_shares(spark, d):
    """Share asked and reached per target source."""
    _, report = _mix(spark, d)
    return spark.createDataFrame([tuple(r.values()) for r in report], mixing.REPORT)
