"""Ordered-document operators; orders are documents and their lines are blocks."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from arborlake.operators import ordered as O
from arborlake.operators.ranking import full_rank, sliding_pairs
from arborlake.plans import query
from arborlake.runtime import table


def blocks(spark, d):
    """Line numbers repeat within an order, so positions are ranks."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_returnflag")
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("doc"), F.row_number().over(w).alias("pos"), (F.col("l_partkey") % 4 + 1).cast("int").alias("level"),
        F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("text"), (F.col("l_returnflag") == "R").alias("generic"), (F.col("l_returnflag") == "N").alias("body"),
    )


B = """b as (select l_orderkey doc, cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_quantity, l_extendedprice, l_returnflag) as integer) pos,
 cast(l_partkey % 4 + 1 as integer) lvl, concat('p', l_partkey) t, l_returnflag = 'R' generic, l_returnflag = 'N' body from lineitem)"""
#: Open ancestors by definition: earlier, shallower, nothing as shallow in between.
ANC = f"""with {B}, anc as (select r.doc, r.pos, x.lvl xl, x.t xt, x.generic xg from b r join b x on x.doc = r.doc and x.pos < r.pos and x.lvl < r.lvl
 where not exists (select 1 from b y where y.doc = r.doc and y.pos > x.pos and y.pos < r.pos and y.lvl <= x.lvl))"""


@query("wn01_heading_path", ANC + ", p as (select doc, pos, string_agg(xt, ' > ' order by xl) path from anc where not xg group by all) select b.doc, b.pos, coalesce(p.path, '') path from b left join p on b.doc = p.doc and b.pos = p.pos")
def wn01(spark, d):
    return O.heading_path(blocks(spark, d), skip=F.col("generic")).select("doc", "pos", "path")


@query("wn02_shift_levels", ANC + ", p as (select doc, pos, count(*) n from anc where xg group by all) select b.doc, b.pos, cast(greatest(1, b.lvl - coalesce(p.n, 0)) as integer) level, b.lvl level_origin from b left join p on b.doc = p.doc and b.pos = p.pos where not generic")
def wn02(spark, d):
    return O.shift_levels(blocks(spark, d), F.col("generic")).select("doc", "pos", "level", "level_origin")


_SEC = f"with {B}, s as (select *, cast(sum(cast(lvl = 1 as integer)) over (partition by doc order by pos) as integer) section, sum(cast(lvl = 1 as integer)) over (partition by doc) heads from b), k as (select * from s where section > 0 or heads = 0)"


@query("wn03_sections", _SEC + " select doc, pos, section from k")
def wn03(spark, d):
    return O.sections(blocks(spark, d), F.col("level") == 1).select("doc", "pos", "section")


@query("wn04_sub_sections", _SEC + ", u as (select *, cast(sum(cast(lvl = 2 as integer)) over (partition by doc, section order by pos) as integer) sub from k) select doc, pos, section, sub from u where sub > 0")
def wn04(spark, d):
    return O.sub_sections(O.sections(blocks(spark, d), F.col("level") == 1), F.col("level") == 2).select("doc", "pos", "section", "sub")


@query("wn05_inherit_decision", _SEC + " select k.doc, k.pos, h.t inherited from k join (select doc, section, arg_min(t, pos) t from k group by all) h on k.doc = h.doc and k.section = h.section")
def wn05(spark, d):
    return O.inherit(O.sections(blocks(spark, d), F.col("level") == 1), "text", ["doc", "section"]).select("doc", "pos", "inherited")


@query("wn06_body_runs", f"""with {B}, r as (select *, sum(cast(not body as integer)) over (partition by doc order by pos) h from b),
 e as (select doc, h, arg_min(t, pos) title from r where not body group by all),
 g as (select doc, h, min(pos) s, max(pos) m, count(*) n, string_agg(t, chr(10) order by pos) content from r where body and h > 0 group by all)
 select g.doc, e.title, g.s as start, concat(g.s, '-', g.m) as range, concat(g.s, '-', g.s + g.n - 1) range_dense, content from g join e on g.doc = e.doc and g.h = e.h""")
def wn06(spark, d):
    return O.body_runs(blocks(spark, d), ~F.col("body"))


@query("wn07_first_children", f"with {B}, h as (select *, sum(cast(lvl = 1 as integer)) over (partition by doc order by pos) h1 from b), r as (select *, row_number() over (partition by doc, h1 order by pos) rn from h where h1 > 0 and lvl in (2, 3)) select doc, cast(h1 as bigint) h1, string_agg(t, '|' order by pos) children from r where rn <= 3 group by doc, h1")
def wn07(spark, d):
    return O.first_children(blocks(spark, d), 3).select("doc", "h1", F.array_join("children", "|").alias("children"))


@query("wn08_doc_context", f"with {B}, r as (select *, row_number() over (partition by doc, lvl order by pos) rn from b where lvl in (1, 2)), g as (select doc, string_agg(t, '|' order by pos) filter (lvl = 1) a, string_agg(t, '|' order by pos) filter (lvl = 2) b from r where rn <= 10 group by doc) select doc, coalesce(a, b) titles from g")
def wn08(spark, d):
    return O.doc_context(blocks(spark, d)).select("doc", F.array_join("titles", "|").alias("titles"))


@query("wn09_variant_counts", "select doc_id, count(case when coalesce(title, '') <> '' then 1 end) over (partition by source) num_variants from documents")
def wn09(spark, d):
    return O.variant_counts(table(spark, d, "documents").select("doc_id", "source", "title"), "source", "title").select("doc_id", "num_variants")


@query("wn10_explode_variants", "select sample_id, case when part <> '' then part end variant, cast(i as integer) variant_idx from (select distinct sample_id, text_for_embed from policy_corpus_embeddings where text_for_embed is not null), unnest(string_split(text_for_embed, ' > ')) with ordinality u(part, i)")
def wn10(spark, d):
    rows = table(spark, d, "policy_corpus_embeddings").filter("text_for_embed is not null").select("sample_id", "text_for_embed").distinct()
    return O.explode_variants(rows, F.split("text_for_embed", " > ")).select("sample_id", F.nullif("variant", F.lit("")).alias("variant"), "variant_idx")


@query("wn11_rank_in_source", "select id_a, id_b, cast(row_number() over (partition by id_a order by s desc, id_b) - 1 as integer) rank_pos from (select id_a, id_b, max(rerank_score) s from policy_similarity_rerank_edges where rerank_score >= 0 and not isnan(rerank_score) group by all)")
def wn11(spark, d):
    """Full rank of every neighbour; one source holds a tenth of the rows, so no window per source."""
    e = table(spark, d, "policy_similarity_rerank_edges").filter("rerank_score >= 0 and not isnan(rerank_score)").groupBy("id_a", "id_b").agg(F.max("rerank_score").alias("s"))
    return full_rank(e, "id_a", [F.desc("s"), F.asc("id_b")]).select("id_a", "id_b", (F.col("rank") - 1).alias("rank_pos"))


@query("wn13_sliding_pairs", """with o as (select doc_id, issuer_id, row_number() over (partition by source, issuer_id order by doc_id) ord, source from documents where issuer_id is not null and source is not null)
 select a.doc_id id_a, b.doc_id id_b from o a join o b on a.source = b.source and a.issuer_id = b.issuer_id and b.ord between a.ord + 1 and a.ord + 49""")
def wn13(spark, d):
    """Each row with the next 49 of its group; one issuer holds a tenth of the rows."""
    docs = table(spark, d, "documents").select("doc_id", "source", "issuer_id")
    return sliding_pairs(docs, ["source", "issuer_id"], [F.col("doc_id")], "doc_id", 49)


@query("jn15_range_texts", f"""with {B}, r as (select doc, min(pos) a, max(pos) z from b where body group by doc)
 select r.doc, concat(r.a, '-', r.z) as range, string_agg(b.t, chr(10) order by b.pos) as text from r join b on b.doc = r.doc and b.pos between r.a and r.z group by all""")
def jn15(spark, d):
    b = blocks(spark, d)
    spans = b.filter("body").groupBy("doc").agg(F.concat_ws("-", F.min("pos"), F.max("pos")).alias("range"))
    return O.range_texts(spans, b)


@query("gr12_granularity", f"""with {B}, g as (select source, string_agg(title, ' ' order by doc_id) j from (select *, row_number() over (partition by source order by doc_id) rn from documents where title is not null) where rn <= 10 group by source)
, k as (select source, case when regexp_matches(j, '体系|框架|战略|布局') then 'macro' when regexp_matches(j, '^(完善|提升|加强|优化|统筹|推进|发展|建设)') then 'meso' else 'micro' end granularity from g)
 select source, granularity, case granularity when 'micro' then 0.6::double else 0.7::double end confidence from k""")
def gr12(spark, d):
    from arborlake.functions.text import granularity, granularity_confidence

    docs = table(spark, d, "documents").filter("title is not null").select("source", "doc_id", "title")
    top = docs.withColumn("r", F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))).filter("r <= 10")  # limited before the shuffle
    joined = top.groupBy("source").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "title"))), lambda x: x["title"]), " ").alias("j"))
    return joined.select("source", granularity(F.col("j")).alias("granularity")).withColumn("confidence", granularity_confidence(F.col("granularity")))


@query("ag22_group_units", f"with {B} select doc, lvl as level, string_agg(t, '|' order by pos) units, count(*) n from b where body group by all")
def ag22(spark, d):
    """Units of the same document and anchor as one list."""
    return blocks(spark, d).filter("body").groupBy("doc", "level").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "|").alias("units"), F.count("*").alias("n")
    )


@query("st01_sort_blocks", "select l_orderkey doc, l_linenumber pos from lineitem order by 1, 2")
def st01(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("pos")).orderBy("doc", "pos")
