"""Sources, decisions and evidence: files are written to shared storage and read back."""

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from arborlake.functions import json_text as J
from arborlake.operators import decisions as D
from arborlake.operators import evidence as E
from arborlake.operators import graph as G
from arborlake.operators.reshape import upsert
from arborlake.plans import query
from arborlake.plans.text_queries import s_tokens
from arborlake.runtime import Stage, shared_dir, table
from arborlake.sources import tables as S


def _path(spark, name):
    return f"{shared_dir(spark)}/io-{uuid.uuid4().hex[:12]}/{name}"


def _customers(spark, d):
    c = table(spark, d, "customer")
    return c.select(F.col("c_custkey").cast("string").alias("c_custkey"), F.when(F.col("c_custkey") % 5 == 0, "NA").when(F.col("c_custkey") % 7 == 0, "").otherwise(F.concat("c_name", F.lit(',"\n')) ).alias("note"))


_NOTE = "case when c_custkey % 5 = 0 then {na} when c_custkey % 7 = 0 then {empty} else concat(c_name, ',\"', chr(10)) end note"


@query("io01_csv_missing_as_null", f"select c_custkey::varchar c_custkey, {_NOTE.format(na='null', empty='null')} from customer")
def io01(spark, d):
    p = _path(spark, "csv")
    S.write_csv(_customers(spark, d), p)
    return S.read_csv(spark, p)


@query("io02_csv_keeps_na", "select c_custkey::varchar c_custkey, " + _NOTE.format(na="'NA'", empty="''") + " from customer")
def io02(spark, d):
    p = _path(spark, "csv")
    S.write_csv(_customers(spark, d), p)
    return S.read_csv(spark, p, missing_as_null=False)


@query("io03_csv_with_mark", "select r_regionkey::varchar r_regionkey, r_name from region")
def io03(spark, d):
    p = _path(spark, "csv")
    r = table(spark, d, "region").select(F.col("r_regionkey").cast("string").alias("\ufeffr_regionkey"), "r_name").coalesce(1)
    S.write_csv(r, p)
    return S.read_csv(spark, p)


@query("io04_pairs_gzip", "select id_a, id_b, max(rerank_score) sim from policy_similarity_rerank_edges where rerank_score >= 0 and not isnan(rerank_score) and id_a is not null and id_b is not null group by all")
def io04(spark, d):
    p = _path(spark, "pairs")
    e = table(spark, d, "policy_similarity_rerank_edges").filter("rerank_score >= 0 and not isnan(rerank_score) and id_a is not null and id_b is not null").groupBy("id_a", "id_b").agg(F.max("rerank_score").alias("SIM"))
    S.write_csv(e.withColumnRenamed("id_a", "ID_A"), p, gzip=True)
    return S.read_pairs(spark, p, only=["id_a", "id_b", "sim"])


@query("io05_vector_layouts", "select vector is not null or coalesce(starts_with(embedding, '['), false) readable, count(*) n from policy_corpus_embeddings group by 1")
def io05(spark, d):
    v = S.read_vectors(table(spark, d, "policy_corpus_embeddings"))
    return v.groupBy(F.col("vector").isNotNull().alias("readable")).agg(F.count("*").alias("n"))


@query("io06_vector_cache", "select vec_id, round(list_sum(list_transform(embedding, lambda x: x::double)), 4) s from embeddings")
def io06(spark, d):
    """Written as parquet and read back."""
    p = _path(spark, "vectors")
    S.write_vectors(table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vector")), p)
    v = S.read_vectors(spark.read.parquet(p), "vec_id")
    return v.select("vec_id", F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x), 4).alias("s"))


@query("io07_vector_columns", "select vec_id, cast(len(embedding) as integer) n from embeddings")
def io07(spark, d):
    """One column per dimension back to arrays."""
    wide = table(spark, d, "embeddings").select("vec_id", *[F.element_at("embedding", i + 1).alias(f"dim_{i}") for i in range(64)])
    return S.read_vectors(wide, "vec_id").select("vec_id", F.size("vector").alias("n"))


@query("io08_nested_tree", "select r_regionkey tree, 'ROOT' node_id, null parent_id from region union all select r_regionkey, 'R' || r_regionkey, 'ROOT' from region union all select n_regionkey, 'N' || n_nationkey, 'R' || n_regionkey from nation union all select n_regionkey, 'C' || c_custkey, 'N' || n_nationkey from customer join nation on n_nationkey = c_nationkey")
def io08(spark, d):
    """Customers below nations below regions: one nested document per region, written as files and read
    back as adjacency rows."""
    r, n, c = table(spark, d, "region"), table(spark, d, "nation"), table(spark, d, "customer")
    name = lambda p, k: F.concat(F.lit(p), F.col(k).cast("string"))
    rows = r.select(F.col("r_regionkey").alias("tree"), F.lit("ROOT").alias("node_id"), F.lit("").alias("label"), F.lit("ROOT").alias("level"), F.lit(None).cast("string").alias("parent_id"), F.lit(0).cast("long").alias("ord"))
    rows = rows.union(r.select("r_regionkey", name("R", "r_regionkey"), "r_name", F.lit("L1"), F.lit("ROOT"), F.col("r_regionkey").cast("long")))
    rows = rows.union(n.select("n_regionkey", name("N", "n_nationkey"), "n_name", F.lit("L2"), name("R", "n_regionkey"), F.col("n_nationkey").cast("long")))
    rows = rows.union(c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("n_regionkey", name("C", "c_custkey"), "c_name", F.lit("L3"), name("N", "n_nationkey"), F.col("c_custkey").cast("long")))
    p = _path(spark, "trees")
    S.tree_documents(rows, "tree").write.partitionBy("tree").text(p)
    back = S.load_trees(spark, f"{p}/tree=*/*.txt")
    return back.select(F.regexp_extract("file", "tree=([0-9]+)/", 1).cast("long").alias("tree"), "node_id", "parent_id")


@query("io09_json_lines", "select event_type, count(*) n from events group by 1")
def io09(spark, d):
    p = _path(spark, "log")
    e = table(spark, d, "events").select("event_id", "event_type")
    S.append_json_lines(e.filter("event_id % 2 = 0"), p)
    S.append_json_lines(e.filter("event_id % 2 = 1"), p)
    return S.read_json_lines(spark, p, "event_id long, event_type string").groupBy("event_type").agg(F.count("*").alias("n"))


@query("io10_skip_bad_lines", "select count(*) n from events where event_id % 10 <> 0")
def io10(spark, d):
    p = _path(spark, "log")
    line = F.when(F.col("event_id") % 10 == 0, F.lit('{"event_id": 1,')).otherwise(F.to_json(F.struct("event_id", "event_type")))
    table(spark, d, "events").select(line.alias("value")).write.text(p)
    return S.read_json_lines(spark, p, "event_id long, event_type string").filter("event_id is not null").agg(F.count("event_type").alias("n"))


@query("io11_upsert", "select o_orderkey, case when o_custkey % 3 = 0 then o_totalprice + 1 else o_totalprice end price from orders where o_custkey % 5 <> 0 or o_custkey % 3 = 0")
def io11(spark, d):
    o = table(spark, d, "orders")
    old = o.filter("o_custkey % 5 <> 0").select("o_orderkey", F.col("o_totalprice").alias("price"))
    new = o.filter("o_custkey % 3 = 0").select("o_orderkey", (F.col("o_totalprice") + 1).alias("price"))
    return upsert(old, new, ["o_orderkey"])


@query("io12_seed_samples", "select l1, sample_id from (select *, row_number() over (partition by l1 order by doc_id, sample_id) r from seed_samples) where r <= 5")
def io12(spark, d):
    return S.seed_samples(table(spark, d, "seed_samples"), 5).select("l1", "sample_id")


@query("io13_raters_of_files", "select distinct judge_key from node_scores where judge_key is not null")
def io13(spark, d):
    """Raters by the names of their score files, which are written first."""
    p = _path(spark, "raters")
    t = table(spark, d, "node_scores").filter("judge_key is not null").select("sample_id", F.concat(F.lit("judge_"), "judge_key", F.lit("_node_scores.jsonl")).alias("file"))
    t.write.partitionBy("file").json(p)
    return spark.createDataFrame([(k,) for k in S.rater_files(spark, p)], "judge_key string")


@query("io14_first_existing", "select count(*) n from nation")
def io14(spark, d):
    return spark.read.parquet(S.first_existing(f"{d}/missing.parquet", f"{d}/nation.parquet", spark=spark)).agg(F.count("*").alias("n"))


@query("io16_partitioned_checkpoint", "select l1_category, count(*) n from tree_nodes_l3 group by 1")
def io16(spark, d):
    p = _path(spark, "parts")
    table(spark, d, "tree_nodes_l3").write.partitionBy("l1_category").parquet(p)
    return spark.read.parquet(p).groupBy("l1_category").agg(F.count("*").alias("n"))


# JSON ------------------------------------------------------------------------------------------------


def _log(spark, d):
    return table(spark, d, "llm_balance_log").select("response_id", F.col("resp.raw").alias("raw"), F.col("resp.json").alias("json")).distinct()


@query("js01_parse_json")
def js01(spark, d):
    return _log(spark, d).select("response_id", J.parse_json(F.col("raw")).alias("p")).select("response_id", "p.ok", "p.json")


@query("js02_balanced_object")
def js02(spark, d):
    return _log(spark, d).select("response_id", J.balanced(F.col("raw")).alias("object")).filter("object is not null")


@query("js03_inner_quotes")
def js03(spark, d):
    return _log(spark, d).select("response_id", J.inner_quotes(F.col("raw")).alias("fixed"))


@query("js04_canonical")
def js04(spark, d):
    return _log(spark, d).filter("json is not null").select("response_id", J.canonical(F.col("json")).alias("canonical"))


@query("js05_vector_text", "select sample_id, count(*) n from policy_corpus_embeddings where starts_with(embedding, '[') group by 1")
def js05(spark, d):
    t = table(spark, d, "policy_corpus_embeddings").filter(J.vector(F.col("embedding")).isNotNull())
    return t.groupBy("sample_id").agg(F.count("*").alias("n"))


# decisions --------------------------------------------------------------------------------------------


def _decisions(spark, d):
    """Answers of the log as decisions by prompt hash."""
    l = table(spark, d, "llm_balance_log").filter("prompt_hash is not null")
    return l.select("task", F.col("prompt_hash").alias("key"), F.coalesce("resp.ok", F.lit(False)).alias("ok"), F.get_json_object("resp.json", "$.action").alias("response"), F.lit(0.8).alias("confidence"))


_DECS = "dec as (select task, prompt_hash, max(resp.json->>'$.action') response from llm_balance_log where resp.ok and prompt_hash is not null group by all)"


@query("ex01_profile", "select 'm' model, 90 timeout_s, 3 retries")
def ex01(spark, d):
    p = D.Profile().resolve({"timeout_s": 90}, {"DECISION_MODEL": "m", "DECISION_TIMEOUT_S": "5"})
    return spark.createDataFrame([(p.model, p.timeout_s, p.retries)], "model string, timeout_s int, retries int")


@query("ex02_decide", f"with {_DECS}, q as (select distinct prompt_hash from llm_balance_log where prompt_hash is not null) select q.prompt_hash, coalesce(dec.response, 'keep') response, case when dec.prompt_hash is null then 'fallback' else 'decision' end decided_by from q left join dec on dec.prompt_hash = q.prompt_hash and dec.task = 'jump'")
def ex02(spark, d):
    q = table(spark, d, "llm_balance_log").select("prompt_hash").filter("prompt_hash is not null").distinct()
    return D.decide(q, _decisions(spark, d), "jump", "prompt_hash", F.lit("keep")).select("prompt_hash", "response", "decided_by")


@query("ex03_hashed_vectors")
def ex03(spark, d):
    v = D.hashed_vectors(table(spark, d, "documents"), "doc_id", "title")
    return v.select("doc_id", F.size("v").alias("dim"))


@query("ex04_overlap_scores", f"""with p as (select distinct id_a, id_b from policy_similarity_rerank_edges), n as (select sample_id, max(text_for_embed) x from policy_corpus_embeddings group by 1), t as (select sample_id, list_distinct({s_tokens('x')}) t from n),
j as (select id_a, id_b, coalesce(a.t, []) x, coalesce(b.t, []) y from p left join t a on a.sample_id = id_a left join t b on b.sample_id = id_b)
select id_a, id_b, round(case when len(x) + len(y) = 0 then 0.0::double else len(list_intersect(x, y))::double / (len(x) + len(y) - len(list_intersect(x, y))) end, 6) rerank_score from j""")
def ex04(spark, d):
    """Scores of all distinct pairs by token overlap."""
    pairs = table(spark, d, "policy_similarity_rerank_edges").select("id_a", "id_b").distinct()
    texts = table(spark, d, "policy_corpus_embeddings").groupBy(F.col("sample_id").alias("id")).agg(F.max("text_for_embed").alias("text"))
    return D.overlap_scores(pairs, texts).select("id_a", "id_b", F.round("rerank_score", 6).alias("rerank_score"))


@query("ex04_rerank_provider", """with p as (select id_a, id_b, row_number() over (partition by id_a order by id_b) r from (select distinct id_a, id_b from policy_similarity_rerank_edges)),
c as (select *, cast((r - 1) // 20 as integer) chunk, (r - 1) % 20 pos from p), k as (select *, (chunk + length(id_a) + ascii(right(id_a, 1))) % 5 layout, count(*) over (partition by id_a, chunk) n from c)
select id_a, id_b, case when layout = 4 then null when layout = 0 and pos = n - 1 then 0.0 else (pos + 1) / 32.0 end::double rerank_score from k""")
def ex04_provider(spark, d):
    """Requests of 20 partners and the responses of a provider in every layout it has: by index in any
    order with one missing, as objects in order, as pairs, as numbers, and failed ones."""
    req = Stage(spark, "rerank").save(D.rerank_requests(table(spark, d, "policy_similarity_rerank_edges")))
    n = F.size("documents")
    layout = F.expr("(chunk + length(id_a) + ascii(right(id_a, 1))) % 5")
    each = lambda f: F.transform(F.sequence(F.lit(0), n - 1), f)
    score = lambda i: ((i + 1) / 32.0).cast("string")
    indexed = F.concat(F.lit('{"results": ['), F.array_join(F.reverse(F.slice(each(lambda i: F.concat(F.lit('{"index": '), i.cast("string"), F.lit(', "relevance_score": '), score(i), F.lit("}"))), 1, n - 1)), ", "), F.lit(', {"index": 99, "score": 1}]}'))
    indexed = F.when(n == 1, '{"results": [{"index": 99, "score": 1}]}').otherwise(indexed)
    objects = F.concat(F.lit('{"output": {"results": ['), F.array_join(each(lambda i: F.concat(F.lit('{"score": '), score(i), F.lit("}"))), ","), F.lit("]}}"))
    two = F.concat(F.lit('{"data": ['), F.array_join(each(lambda i: F.concat(F.lit('["x", '), score(i), F.lit("]"))), ","), F.lit("]}"))
    plain = F.concat(F.lit('{"data": ['), F.array_join(each(score), ","), F.lit("]}"))
    answer = F.when(layout == 0, indexed).when(layout == 1, objects).when(layout == 2, two).when(layout == 3, plain).otherwise("503 unavailable")
    return D.rerank_results(req, req.select("id_a", "chunk", answer.alias("response")))


@query("ex05_resume", "with s as (select distinct response_id::varchar sample_id from llm_balance_log), d as (select distinct response_id::varchar sample_id from llm_balance_log where response_id % 2 = 0) select count(*) n from s where sample_id not in (select sample_id from d) and cast(sample_id as bigint) % 5 <> 0")
def ex05(spark, d):
    s = table(spark, d, "llm_balance_log").select(F.col("response_id").cast("string").alias("sample_id"))
    dec = s.distinct().filter("cast(sample_id as bigint) % 5 <> 0").select(F.lit("t").alias("task"), F.col("sample_id").alias("key"), F.lit(True).alias("ok"), F.lit("x").alias("response"), F.lit(1.0).alias("confidence"))
    return D.resume(s, s.filter("cast(sample_id as bigint) % 2 = 0"), dec, "t").agg(F.count("*").alias("n"))


@query("ex06_extract_units", "select concat('T5_', l_orderkey, '_', lpad(l_linenumber::varchar, 5, '0'), '_01') unit_id, concat('p', l_partkey) unit from (select l_orderkey, l_linenumber, max(l_partkey) l_partkey from lineitem group by all)")
def ex06(spark, d):
    r = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_partkey").alias("p"))
    r = r.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("block"), F.to_json(F.array(F.lit(" "), F.concat(F.lit("p"), F.col("p").cast("string")))).alias("response"))
    return D.extract_units(r).select("unit_id", "unit")


@query("ex07_clean_titles", "select n_nationkey, concat(n_name, '|x') titles from nation")
def ex07(spark, d):
    n = table(spark, d, "nation")
    resp = F.to_json(F.array(F.concat(F.lit(" "), "n_name"), F.col("n_name"), F.lit(""), F.lit("x"), F.lit("x ")))
    return n.select("n_nationkey", F.array_join(D.clean_titles(resp), "|").alias("titles"))


@query("ex08_granularity_decision", "select n_nationkey, case n_nationkey % 3 when 0 then 'macro' else 'meso' end granularity, case n_nationkey % 3 when 0 then 1.0::double when 1 then 0.5::double else 0.4::double end confidence from nation")
def ex08(spark, d):
    resp = F.when(F.col("n_nationkey") % 3 == 0, F.lit('{"granularity": " Macro", "confidence": 1.7}')).when(F.col("n_nationkey") % 3 == 1, F.lit('{"granularity": "huge", "confidence": 0}'))
    return table(spark, d, "nation").select("n_nationkey", D.granularity_decision(resp).alias("x")).select("n_nationkey", "x.*")


@query("ex09_edit_events", "select op, count(*) n from (select case event_type when 'error' then 'merge' when 'click' then 'move' else 'flag' end op from events) group by 1")
def ex09(spark, d):
    """Edit events written as a JSON log and read back with the event schema."""
    p = _path(spark, "events")
    op = F.when(F.col("event_type") == "error", "merge").when(F.col("event_type") == "click", "move").otherwise("flag")
    S.append_json_lines(table(spark, d, "events").select(F.col("event_id").alias("seq"), op.alias("op"), F.col("event_id").cast("string").alias("node_id")), p)
    return S.read_json_lines(spark, p, D.EVENT_SCHEMA).groupBy("op").agg(F.count("*").alias("n"))


@query("gr09_adjudicate", """with a as (select prompt_hash, max(case when resp.ok then resp.json->>'$.action' end) p, min(case when resp.status = 200 and resp.fix_err is null then resp.json->>'$.action' end) s, max(resp.latency_ms) lp, min(resp.latency_ms) ls from llm_balance_log where prompt_hash is not null group by 1)
 select prompt_hash, case when p is null and s is null then 'both_failed' when s is null then 'primary_only' when p is null then 'secondary_only' when p = s then 'agree' when (lp - ls) / 1000.0 >= 0.10 then 'primary' else 'conservative' end decision from a""")
def gr09(spark, d):
    act = F.get_json_object("resp.json", "$.action")
    g = table(spark, d, "llm_balance_log").filter("prompt_hash is not null").groupBy("prompt_hash").agg(
        F.max(F.when(F.col("resp.ok"), act)).alias("p"), F.min(F.when((F.col("resp.status") == 200) & F.col("resp.fix_err").isNull(), act)).alias("s"), F.max("resp.latency_ms").alias("lp"), F.min("resp.latency_ms").alias("ls"))
    return g.select("prompt_hash", D.adjudicate(F.col("p"), F.col("s"), F.col("lp") / 1000.0, F.col("ls") / 1000.0).alias("decision"))


@query("gr10_assign_categories", """with h as (select c_custkey head_id from customer), d as (select c_custkey k, case c_custkey % 4 when 0 then 'DISCARD' when 1 then c_mktsegment when 2 then 'New topic' end r, case c_custkey % 4 when 1 then 1 when 2 then 2 else 1 end rd from customer)
 select head_id, coalesce(r, 'Unknown_Cluster') category, concat('L1_N', substr(md5(coalesce(r, 'Unknown_Cluster')), 1, 8)) category_id, case when r is null then 0 else rd end as round from h join d on d.k = h.head_id where coalesce(r, '') <> 'DISCARD'""")
def gr10(spark, d):
    c = table(spark, d, "customer")
    k = F.col("c_custkey") % 4
    dec = c.filter(k != 3).select(F.when(k == 2, "round2").otherwise("round1").alias("task"), F.col("c_custkey").cast("string").alias("key"), F.lit(True).alias("ok"), F.when(k == 0, "DISCARD").when(k == 1, F.col("c_mktsegment")).otherwise("New topic").alias("response"), F.lit(1.0).alias("confidence"))
    cats = c.select(F.col("c_mktsegment").alias("name")).distinct().withColumn("id", F.concat(F.lit("L1_N"), F.substring(F.md5("name"), 1, 8)))
    return D.assign_categories(c.select(F.col("c_custkey").alias("head_id")), dec, cats)


# evidence ---------------------------------------------------------------------------------------------


@query("ev01_numbered_titles", "select r_regionkey, string_agg(concat(i, '. ', n_name), chr(10) order by i) listing from (select n_regionkey r_regionkey, n_name, row_number() over (partition by n_regionkey order by n_nationkey) i from nation) where i <= 3 group by 1")
def ev01(spark, d):
    n = table(spark, d, "nation").withColumn("r", F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey"))).filter("r <= 3")
    a = n.groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "n_name"))), lambda x: x["n_name"]).alias("t"))
    return a.select("r_regionkey", E.numbered(F.col("t")).alias("listing"))


@query("ev02_first_titles", "select o_custkey, string_agg(substr(o_orderpriority, 1, 20), '；' order by o_orderkey) texts from (select *, row_number() over (partition by o_custkey order by o_orderkey) r from orders) where r <= 5 group by 1")
def ev02(spark, d):
    return E.first_texts(table(spark, d, "orders"), "o_custkey", [F.asc("o_orderkey")], "o_orderpriority", 5, width=20)


@query("ev03_children_listing", "select parent_id, string_agg(child_id, chr(10) order by child_id) children from (select parent_id, child_id, row_number() over (partition by parent_id order by child_id) r from (select distinct parent_id, child_id from tree_parent_links_l3_to_l2 where parent_id is not null)) where r <= 30 group by 1")
def ev03(spark, d):
    l = table(spark, d, "tree_parent_links_l3_to_l2").filter("parent_id is not null").select("parent_id", "child_id").distinct()
    return E.first_texts(l, "parent_id", [F.asc("child_id")], "child_id", 30, sep="\n", name="children")


@query("ev04_candidate_margin", """with s as (select c_custkey, s_suppkey, 1 - abs(c_acctbal - s_acctbal) / 11000 score, row_number() over (partition by c_custkey order by round(1 - abs(c_acctbal - s_acctbal) / 11000, 9) desc, s_suppkey) r from customer join supplier on c_nationkey = s_nationkey)
 select c_custkey child_id, round(max(case when r = 1 then score end) - coalesce(max(case when r = 2 then score end), 0.0::double), 6) margin from s group by 1""")
def ev04(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("node_id"), F.col("c_nationkey").alias("l1"), "c_acctbal")
    p = table(spark, d, "supplier").select(F.col("s_suppkey").alias("node_id"), F.col("s_nationkey").alias("l1"), "s_acctbal")
    top = G.scored_candidates(c, p, lambda a, b: 1 - F.abs(a - b) / 11000, 8, near=("c_acctbal", "s_acctbal"))
    return E.candidate_listing(top).select("child_id", F.round("margin", 6).alias("margin"))


@query("ev05_label_listing", "select l1_category, string_agg(label, '；' order by r) texts from (select l1_category, label, row_number() over (partition by l1_category order by node_id) r from (select l1_category, node_id, max(label) label from tree_nodes_l3 where label <> '' group by all)) where r <= 8 group by 1")
def ev05(spark, d):
    n = table(spark, d, "tree_nodes_l3").filter("label <> ''").groupBy("l1_category", "node_id").agg(F.max("label").alias("label"))
    return E.first_texts(n, "l1_category", [F.asc("node_id")], "label", 8)


@query("ev06_rating_prompt")
def ev06(spark, d):
    n = table(spark, d, "node_scores").select("sample_id", F.struct("node_id", "level", "depth").alias("node")).distinct()
    return n.select("sample_id", E.rating_prompt(F.col("node"), "Rate the node.").alias("prompt"))


@query("ev07_merge_line")
def ev07(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.avg("l_tax").alias("m"), F.percentile("l_tax", F.lit(0.75)).alias("p"), F.count("*").alias("n"))
    return g.select("l_returnflag", E.merge_line(F.col("l_returnflag"), F.lit("X"), F.col("m"), F.col("p"), F.col("n")).alias("line"))


@query("rp04_summary_text", "select 'nodes' metric, count(*)::varchar as value from tree_nodes_l3")
def rp04(spark, d):
    n = table(spark, d, "tree_nodes_l3").count()
    text = E.summary_text({"nodes": n})
    return spark.createDataFrame([tuple(text.split())], "metric string, value string")


@query("hp09_env_file", "select 'A' k, '1' v union all select 'B', 'x=y'")
def hp09(spark, d):
    return spark.createDataFrame(list(D.parse_env("# c\nA=1\nexport B='x=y'\n\nbad line").items()), "k string, v string")
