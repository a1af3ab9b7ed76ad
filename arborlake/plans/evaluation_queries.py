"""Scores, agreement, sampling and set operators over the judges' tables."""

from pyspark.sql import functions as F

from arborlake.functions import text as T
from arborlake.operators import agreement as A
from arborlake.operators import sampling as M
from arborlake.operators.reshape import keep_last
from arborlake.plans import query
from arborlake.plans.text_queries import sql_list
from arborlake.runtime import table

PD = tuple(A.PATH_WEIGHTS)
ND = tuple(A.NODE_WEIGHTS)


def paths(spark, d):
    """Path scores: copies once, ratings held to 1..5."""
    p = table(spark, d, "path_scores").filter("sample_id is not null and judge_key is not null")
    p = keep_last(p.select("sample_id", "judge_key", "path_length", "l1_label", *[T.rating(F.col(f"result.scores.{x}")).alias(x) for x in PD], F.col("result.flags").alias("flags")), ["sample_id", "judge_key"], F.struct(*PD))
    return p


def nodes(spark, d):
    n = table(spark, d, "node_scores").filter("sample_id is not null and judge_key is not null")
    n = n.select("sample_id", "judge_key", "node_id", "level", "l1_label", "high_risk", *[T.rating(F.col(f"result.scores.{x}")).alias(x) for x in ND], F.col("result.flags").alias("flags"), "scored_at")
    return keep_last(n, ["sample_id", "judge_key"], F.col("scored_at"))


PS = """with p as (select distinct sample_id, judge_key, path_length, l1_label, greatest(1, least(5, result.scores.path_coherence)) pc0, greatest(1, least(5, result.scores.granularity_progression)) gp0,
 result.scores.path_coherence r1, result.scores.granularity_progression r2, result.flags flags from path_scores),
ps as (select sample_id, judge_key, path_length, l1_label, case when r1 is not null then pc0 end path_coherence, case when r2 is not null then gp0 end granularity_progression, flags from p)"""
_CL = "case when result.scores.{0} is not null then greatest(1, least(5, result.scores.{0})) end {0}"
NS = f"""with r as (select *, row_number() over (partition by sample_id, judge_key order by scored_at desc) k from node_scores),
ns as (select sample_id, judge_key, node_id, level, l1_label, high_risk, {', '.join(_CL.format(x) for x in ND)}, result.flags flags from r where k = 1)"""


def s_pen(table_):
    cases = " ".join(f"when '{k}' then {v}::double" for k, v in table_.items())
    return f"coalesce(list_sum(list_transform(coalesce(flags, []), lambda f: case f {cases} else 0.0::double end)), 0.0::double)"


_RAWN = "(0.40::double * vertical_coherence + 0.35::double * horizontal_coherence + 0.25::double * label_quality)"
_RAWP = "(0.55::double * path_coherence + 0.45::double * granularity_progression)"
NSC = NS + f", nsc as (select *, {_RAWN} raw, case when {_RAWN} is not null then greatest(1.0::double, {_RAWN} - {s_pen(A.NODE_PENALTIES)}) end adjusted from ns)"
PSC = f"psc as (select *, {_RAWP} raw, case when {_RAWP} is not null then greatest(1.0::double, {_RAWP} - {s_pen(A.PATH_PENALTIES)}) end adjusted from ps)"


@query("ag10_weighted_scores", NSC + " select sample_id, judge_key, round(raw, 6) raw, round(adjusted, 6) adjusted from nsc")
def ag10(spark, d):
    s = A.weighted_scores(nodes(spark, d), A.NODE_WEIGHTS, A.NODE_PENALTIES)
    return s.select("sample_id", "judge_key", F.round("raw", 6).alias("raw"), F.round("adjusted", 6).alias("adjusted"))


def _pairs_sql(dim, by=""):
    b = f"{by}, " if by else ""
    return f"""select '{dim}' dimension, {b}judge_a, judge_b, count(*) n, round(case when avg(a * a) + avg(b * b) - 2 * avg(a) * avg(b) > 1e-12::double then 1 - avg((a - b) * (a - b)) / (avg(a * a) + avg(b * b) - 2 * avg(a) * avg(b)) end, 6) weighted_kappa
 from (select {'x.' + by + ', ' if by else ''}x.judge_key judge_a, y.judge_key judge_b, x.{dim}::double a, y.{dim}::double b from ps x join ps y on x.sample_id = y.sample_id and x.judge_key < y.judge_key where x.{dim} is not null and y.{dim} is not null) group by {b}judge_a, judge_b"""


@query("ag11_weighted_kappa", PS + " " + " union all ".join(_pairs_sql(x) for x in PD))
def ag11(spark, d):
    p = paths(spark, d)
    judges = A.panel(p)
    parts = [A.pairwise_kappa(p, x, judges).withColumn("dimension", F.lit(x)) for x in PD]
    return parts[0].unionByName(parts[1]).withColumn("weighted_kappa", F.round("weighted_kappa", 6))


@query("jn12_rater_pairs", PS + " select x.judge_key judge_a, y.judge_key judge_b, count(*) n from ps x join ps y on x.sample_id = y.sample_id and x.judge_key < y.judge_key where x.path_coherence is not null and y.path_coherence is not null group by all")
def jn12(spark, d):
    p = paths(spark, d)
    return A.pairwise_kappa(p, "path_coherence", A.panel(p)).select("judge_a", "judge_b", "n")


def _alpha_sql(src, dim):
    return f"""select '{dim}' dimension, round(1 - (sum(n * q - s * s) / sum(n * (n - 1) / 2)) / ((sum(n) * sum(q) - sum(s) * sum(s)) / (sum(n) * (sum(n) - 1) / 2)), 6) alpha from (select sample_id, count(*)::double n, sum({dim})::double s, sum({dim} * {dim})::double q from {src} where {dim} is not null group by sample_id having count(*) > 1)"""


@query("ag12_interval_alpha", NS + " " + " union all ".join(_alpha_sql("ns", x) for x in ND))
def ag12(spark, d):
    n = nodes(spark, d)
    parts = [A.interval_alpha(n, x).select(F.lit(x).alias("dimension"), F.round("alpha", 6).alias("alpha")) for x in ND]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


FLAGS = tuple(A.PATH_PENALTIES)
_FA = PS + f""", whole as (select sample_id from ps group by sample_id having count(distinct judge_key) = 3),
 b as (select f.flag, ps.sample_id, ps.judge_key, cast(list_contains(coalesce(ps.flags, []), f.flag) as integer) v from ps join whole on ps.sample_id = whole.sample_id cross join (select unnest({sql_list(FLAGS)}) flag) f),
 t as (select flag, sample_id, sum(v) s from b group by all),
 pr as (select x.flag, x.judge_key a, y.judge_key b, count(*)::double n, sum(cast(x.v = y.v as integer)) e, sum(x.v) sa, sum(y.v) sb from b x join b y on x.flag = y.flag and x.sample_id = y.sample_id and x.judge_key < y.judge_key group by all),
 kp as (select flag, case when abs((sa / n) * (sb / n) + (1 - sa / n) * (1 - sb / n) - 1) > 1e-12::double then (e / n - ((sa / n) * (sb / n) + (1 - sa / n) * (1 - sb / n))) / (1 - ((sa / n) * (sb / n) + (1 - sa / n) * (1 - sb / n))) end k from pr)"""


@query("ag13_binary_kappa", _FA + " select flag, round(avg(k), 6) mean_kappa from kp group by flag")
def ag13(spark, d):
    p = paths(spark, d)
    return A.flag_agreement(p, list(FLAGS), A.panel(p)).select("flag", F.round("mean_kappa", 6).alias("mean_kappa"))


@query("ag14_flag_agreement", _FA + " select flag, count(*) n_evaluated, round(avg(cast(s in (0, 3) as integer)), 6) full_agreement, round(avg(cast(greatest(s, 3 - s) > 1.5 as integer)), 6) majority_agreement from t group by flag")
def ag14(spark, d):
    p = paths(spark, d)
    return A.flag_agreement(p, list(FLAGS), A.panel(p)).select("flag", "n_evaluated", F.round("full_agreement", 6).alias("full_agreement"), F.round("majority_agreement", 6).alias("majority_agreement"))


@query("rp03_flag_rates", _FA + " select flag, judge_key, round(avg(v), 6) rate from b group by all")
def rp03(spark, d):
    p = paths(spark, d)
    judges = A.panel(p)
    wide = A.flag_agreement(p, list(FLAGS), judges)
    return wide.select("flag", F.explode(F.array(*[F.struct(F.lit(j).alias("judge_key"), F.round(f"rate_{j}", 6).alias("rate")) for j in judges])).alias("x")).select("flag", "x.*")


@query("ag15_mean_kappa", PS + ", k as (" + " union all ".join(_pairs_sql(x, "l1_label") for x in PD) + ") select dimension, l1_label, round(avg(round(weighted_kappa, 4)), 4) mean_kappa from k group by all")
def ag15(spark, d):
    """Mean of the rounded pair kappas per category and dimension."""
    p = paths(spark, d)
    judges = A.panel(p)
    parts = [A.pairwise_kappa(p, x, judges, ["l1_label"]).withColumn("dimension", F.lit(x)) for x in PD]
    k = parts[0].unionByName(parts[1]).filter("n > 0")
    return k.groupBy("dimension", "l1_label").agg(F.round(F.avg(F.round(F.round("weighted_kappa", 6), 4)), 4).alias("mean_kappa"))


@query("rp02_agreement_table", PS + ", k as (" + " union all ".join(_pairs_sql(x) for x in PD) + """) select dimension, max(case when judge_a = 'A_alder' and judge_b = 'B_birch' then weighted_kappa end) a_alder_vs_b_birch, max(case when judge_a = 'A_alder' and judge_b = 'C_cedar' then weighted_kappa end) a_alder_vs_c_cedar,
 max(case when judge_a = 'B_birch' and judge_b = 'C_cedar' then weighted_kappa end) b_birch_vs_c_cedar from k group by dimension""")
def rp02(spark, d):
    p = paths(spark, d)
    judges = A.panel(p)
    parts = [A.pairwise_kappa(p, x, judges).withColumn("dimension", F.lit(x)) for x in PD]
    k = parts[0].unionByName(parts[1]).withColumn("pair", F.lower(F.concat_ws("_vs_", "judge_a", "judge_b")))
    return k.groupBy("dimension").pivot("pair", ["a_alder_vs_b_birch", "a_alder_vs_c_cedar", "b_birch_vs_c_cedar"]).agg(F.round(F.max("weighted_kappa"), 6))


_DIV = "having count(distinct judge_key) = 3 and (greatest(coalesce(max(path_coherence) - min(path_coherence), 0), coalesce(max(granularity_progression) - min(granularity_progression), 0)) >= 2 or count(distinct array_to_string(list_sort(list_distinct(coalesce(flags, []))), '|')) > 1)"


@query("ag16_divergent_paths", PS + f" select sample_id, greatest(coalesce(max(path_coherence) - min(path_coherence), 0), coalesce(max(granularity_progression) - min(granularity_progression), 0)) max_score_diff, count(distinct array_to_string(list_sort(list_distinct(coalesce(flags, []))), '|')) > 1 flag_disagree from ps group by sample_id {_DIV}")
def ag16(spark, d):
    return A.divergent(paths(spark, d), list(PD), 3)


@query("ag17_framework", NSC + ", " + PS.removeprefix("with ") + ", " + PSC + ", n as (select judge_key, avg(adjusted) m from nsc group by 1), q as (select judge_key, avg(adjusted) m from psc group by 1) select coalesce(n.judge_key, q.judge_key) judge_key, round(n.m, 6) mean_node, round(q.m, 6) mean_path, round(coalesce(0.65::double * n.m + 0.35::double * q.m, n.m, q.m), 6) framework from n full outer join q on n.judge_key = q.judge_key")
def ag17(spark, d):
    n = A.weighted_scores(nodes(spark, d), A.NODE_WEIGHTS, A.NODE_PENALTIES)
    p = A.weighted_scores(paths(spark, d), A.PATH_WEIGHTS, A.PATH_PENALTIES)
    return A.framework(n, p).select("judge_key", *[F.round(c, 6).alias(c) for c in ("mean_node", "mean_path", "framework")])


@query("ag18_rater_means", NS + " select judge_key, " + ", ".join(f"round(avg({x}), 6) {x}" for x in ND) + " from ns group by judge_key")
def ag18(spark, d):
    return nodes(spark, d).groupBy("judge_key").agg(*[F.round(F.avg(x), 6).alias(x) for x in ND])


@query("ag19_cluster_confidence", "select l1_category, round_even(greatest(0.6::double, least(1.0::double, avg(confidence))), 4) confidence from tree_nodes_l3 group by l1_category")
def ag19(spark, d):
    return table(spark, d, "tree_nodes_l3").groupBy("l1_category").agg(F.bround(F.greatest(F.lit(0.6), F.least(F.lit(1.0), F.avg("confidence"))), 4).alias("confidence"))


@query("ag20_confidence_report", "select node_id, confidence from (select node_id, min(confidence) confidence from tree_nodes_l3 group by 1) where confidence < 0.65 order by confidence, node_id limit 100")
def ag20(spark, d):
    """The report's first 100 low-confidence nodes."""
    g = table(spark, d, "tree_nodes_l3").groupBy("node_id").agg(F.min("confidence").alias("confidence"))
    return g.filter("confidence < 0.65").orderBy("confidence", "node_id").limit(100)


@query("ag21_error_types", "select substr(split_part(coalesce(resp.fix_err, ''), ':', 1), 1, 120) error, count(*) n from llm_balance_log group by 1")
def ag21(spark, d):
    e = F.substring(F.split_part(F.coalesce("resp.fix_err", F.lit("")), F.lit(":"), F.lit(1)), 1, 120)
    return table(spark, d, "llm_balance_log").groupBy(e.alias("error")).agg(F.count("*").alias("n"))


@query("ag23_first_seen_candidates", "select title, min(sample_id) first_seen from seed_samples where title is not null group by title order by 2, 1 limit 80")
def ag23(spark, d):
    """Distinct candidates in first-seen order; the cap of 80 is the prompt's."""
    return table(spark, d, "seed_samples").filter("title is not null").groupBy("title").agg(F.min("sample_id").alias("first_seen")).orderBy("first_seen", "title").limit(80)


@query("ag24_unit_counters", "select admin_level, count(distinct doc_id) samples, count(*) records, count(distinct issuer_id) issuers from documents group by admin_level")
def ag24(spark, d):
    return table(spark, d, "documents").groupBy("admin_level").agg(F.count_distinct("doc_id").alias("samples"), F.count("*").alias("records"), F.count_distinct("issuer_id").alias("issuers"))


@query("rp01_wide_scores", NSC + " select sample_id, judge_key, " + ", ".join(ND) + ", array_to_string(flags, ';') flags from nsc")
def rp01(spark, d):
    return nodes(spark, d).select("sample_id", "judge_key", *ND, F.array_join("flags", ";").alias("flags"))


# sampling -------------------------------------------------------------------------------------------

_RATIO = "case c_mktsegment when 'BUILDING' then 1.0::double when 'MACHINERY' then 0.5::double else 0.3::double end"
_SM = f"""with h as (select c_custkey, c_mktsegment, row_number() over (partition by c_mktsegment order by md5('20260430|' || c_custkey), c_custkey) r, count(*) over (partition by c_mktsegment) n from customer),
s as (select c_custkey from h where r <= greatest(1, ceil(n * {_RATIO} - 1e-9::double))), risk as (select c_custkey from customer where c_acctbal < 0 union select o_custkey from orders where o_totalprice > 400000)"""


def _sample(spark, d):
    ratio = F.when(F.col("c_mktsegment") == "BUILDING", 1.0).when(F.col("c_mktsegment") == "MACHINERY", 0.5).otherwise(0.3)
    return M.stratified(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", "c_custkey", ratio, "20260430")


def _risk(spark, d):
    a = table(spark, d, "customer").filter("c_acctbal < 0").select("c_custkey")
    b = table(spark, d, "orders").filter("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return M.union_ids(a, b, key="c_custkey")


@query("sm01_stratified_sample", _SM + " select c_custkey from s")
def sm01(spark, d):
    return _sample(spark, d).select("c_custkey")


@query("sm02_risk_set", _SM + " select c_custkey from risk")
def sm02(spark, d):
    return _risk(spark, d)


@query("sm03_forced_sample", _SM + " select c_custkey from s union select c_custkey from risk where c_custkey in (select c_custkey from customer)")
def sm03(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return M.force_in(_sample(spark, d), _risk(spark, d), rows, "c_custkey").select("c_custkey")


@query("sm04_risk_reasons", "select c_custkey, concat_ws(',', case when c_acctbal < 0 then 'negative' end, case when c_mktsegment = 'BUILDING' then 'building' end, case when length(c_name) > 17 then 'long' end) reasons from customer")
def sm04(spark, d):
    r = M.reasons({"negative": F.col("c_acctbal") < 0, "building": F.col("c_mktsegment") == "BUILDING", "long": F.length("c_name") > 17})
    return table(spark, d, "customer").select("c_custkey", F.array_join(r, ",").alias("reasons"))


_PATHS = "with p as (select distinct sample_id, l1_label, path_length from path_scores), n as (select l1_label, count(*) n from p group by 1), q as (select l1_label, greatest(3, cast(round_even(40.0::double * n / (select count(*) from p)::double, 0) as integer)) quota from n)"


def _paths(spark, d):
    return table(spark, d, "path_scores").select("sample_id", "l1_label", "path_length").distinct()


@query("sm05_path_quota", _PATHS + " select l1_label, quota from q")
def sm05(spark, d):
    return M.path_quota(_paths(spark, d), "l1_label")


@query("sm06_pick_paths", _PATHS + """, h as (select *, md5('7|' || sample_id) h, max(path_length) over (partition by l1_label) m from p), two as (select sample_id, l1_label from (select *, row_number() over (partition by l1_label order by h, sample_id) r from h where path_length = m) where r <= 2),
 o as (select *, row_number() over (partition by l1_label order by h, sample_id) r from h where sample_id not in (select sample_id from two)), k as (select l1_label, count(*) k from two group by 1)
, c as (select sample_id from two union select o.sample_id from o join q on o.l1_label = q.l1_label join k on k.l1_label = o.l1_label where r <= quota - k),
 risk as (select distinct sample_id, md5('7|' || sample_id) h from path_scores where list_contains(result.flags, (select max(f) from (select unnest(result.flags) f from path_scores)))),
 more as (select sample_id from (select *, row_number() over (order by h, sample_id) r from risk where sample_id not in (select sample_id from c)) where r <= 200 - (select count(*) from c))
 select sample_id from c union select sample_id from more union (select sample_id from p order by path_length desc, sample_id limit 1)""")
def sm06(spark, d):
    """Quota per category, then paths with the last flag of all as those at risk, up to 200 paths."""
    flags = table(spark, d, "path_scores").select("sample_id", F.explode("result.flags").alias("f"))
    risk = flags.join(flags.agg(F.max("f").alias("f")), "f", "left_semi").select("sample_id")
    return M.pick_paths(_paths(spark, d), "l1_label", "sample_id", "path_length", "7", risk=risk, fill=200)


@query("sm07_uniform_sample", "select doc_id from documents order by md5('audit|' || doc_id), doc_id limit 50")
def sm07(spark, d):
    """Fifty audit tasks in hash order: the sample size is the operator."""
    return table(spark, d, "documents").select("doc_id", M.hash_order("audit", "doc_id").alias("h")).orderBy("h", "doc_id").limit(50).select("doc_id")


@query("rp06_sampling_meta", _SM + " select c.c_mktsegment, count(*) n, count(s.c_custkey) sampled, count(risk.c_custkey) at_risk from customer c left join s on s.c_custkey = c.c_custkey left join risk on risk.c_custkey = c.c_custkey group by 1")
def rp06(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    s, r = _sample(spark, d).select("c_custkey").withColumn("_s", F.lit(1)), _risk(spark, d).withColumn("_r", F.lit(1))
    return c.join(s, "c_custkey", "left").join(r, "c_custkey", "left").groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.count("_s").alias("sampled"), F.count("_r").alias("at_risk"))


# set operators ----------------------------------------------------------------------------------------

_RUN = "raws as (select response_id sample_id, ts seq, case when resp.ok then null else coalesce(resp.fix_err, 'failed') end error from llm_balance_log group by all), done as (select distinct sample_id from raws where error is null and sample_id % 3 <> 0)"


def _runs(spark, d):
    raw = table(spark, d, "llm_balance_log").select(F.col("response_id").alias("sample_id"), F.col("ts").alias("seq"), F.when(~F.coalesce("resp.ok", F.lit(False)), F.coalesce("resp.fix_err", F.lit("failed"))).alias("error")).distinct()
    return raw, raw.filter("error is null and sample_id % 3 <> 0").select("sample_id").distinct()


@query("so01_union_levels", "select child_id, parent_id, 'L3' as level from tree_parent_links_l3_to_l2 union all select child_id, parent_id, 'L4' from tree_parent_links_l4_to_l3")
def so01(spark, d):
    cols = ["child_id", "parent_id"]
    a = table(spark, d, "tree_parent_links_l3_to_l2").select(*cols).withColumn("level", F.lit("L3"))
    return a.unionByName(table(spark, d, "tree_parent_links_l4_to_l3").select(*cols).withColumn("level", F.lit("L4")))


_PROG = f"with {_RUN}, t as (select distinct sample_id from raws), f as (select distinct sample_id from raws where error is not null), j as (select t.sample_id, d.sample_id is not null d, f.sample_id is not null f from t left join done d on d.sample_id = t.sample_id left join f on f.sample_id = t.sample_id)"


@query("so02_progress", _PROG + " select count(*) total, count(*) filter (d) done, count(*) filter (not d and f) failed, count(*) filter (not d and not f) untouched from j")
def so02(spark, d):
    raw, done = _runs(spark, d)
    return M.progress(raw, done, raw.filter("error is not null")).select("total", "done", "failed", "untouched")


@query("rp08_progress_bar", _PROG + ", x as (select count(*) filter (d) / count(*)::double * 100 pct from j) select round(pct, 1) percent, concat(repeat('█', cast(floor(pct / 5) as integer)), repeat('░', 20 - cast(floor(pct / 5) as integer))) bar from x")
def rp08(spark, d):
    raw, done = _runs(spark, d)
    return M.progress(raw, done, raw.filter("error is not null")).select("percent", "bar")


@query("so03_retry_clean", f"with {_RUN}, g as (select * from raws where error is null), l as (select g.sample_id, max(seq) seq from g join done on done.sample_id = g.sample_id group by 1) select g.sample_id, g.seq from g join l on g.sample_id = l.sample_id and g.seq = l.seq union all select g.sample_id, g.seq from g where sample_id not in (select sample_id from done)")
def so03(spark, d):
    raw, done = _runs(spark, d)
    return M.retry_clean(raw, done).select("sample_id", "seq")


@query("so04_distinct_raters", "select judge_key from node_scores union select judge_key from path_scores")
def so04(spark, d):
    return table(spark, d, "node_scores").select("judge_key").union(table(spark, d, "path_scores").select("judge_key")).distinct()


@query("jn08_pending_samples", f"with {_RUN} select distinct sample_id from raws where sample_id not in (select sample_id from done)")
def jn08(spark, d):
    raw, done = _runs(spark, d)
    return raw.select("sample_id").distinct().join(done, "sample_id", "left_anti")


@query("hp01_failed_queue", "select response_id, prompt_hash, resp.fix_err reason from llm_balance_log where not resp.ok group by all")
def hp01(spark, d):
    return table(spark, d, "llm_balance_log").filter("not resp.ok").select("response_id", "prompt_hash", F.col("resp.fix_err").alias("reason")).distinct()


@query("hp02_latest_assignment", "select child_id, arg_max(struct_pack(p := parent_id, d := decision), loaded_at).p parent_id, arg_max(struct_pack(p := parent_id, d := decision), loaded_at).d decision from tree_parent_links_l3_to_l2 group by child_id")
def hp02(spark, d):
    l = table(spark, d, "tree_parent_links_l3_to_l2").select("child_id", "parent_id", "decision", "loaded_at")
    return keep_last(l, ["child_id"], F.col("loaded_at"), F.col("parent_id")).select("child_id", "parent_id", "decision")


@query("hp03_fill_category", """with v as (select n_regionkey, c_mktsegment, count(*) n, min(c_custkey) f from customer join nation on c_nationkey = n_nationkey group by all), m as (select *, row_number() over (partition by n_regionkey order by n desc, f) r from v)
 select n_nationkey node_id, coalesce(nullif(case when n_nationkey % 2 = 0 then n_name else '' end, ''), m.c_mktsegment) category from nation left join m on m.n_regionkey = nation.n_regionkey and r = 1""")
def hp03(spark, d):
    n = table(spark, d, "nation")
    v = table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey", "c_mktsegment").agg(F.count("*").alias("n"), F.min("c_custkey").alias("f"))
    m = v.groupBy("n_regionkey").agg(F.max_by("c_mktsegment", F.struct("n", -F.col("f"))).alias("vote"))
    own = F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).otherwise("")
    return n.join(m, "n_regionkey", "left").select(F.col("n_nationkey").alias("node_id"), F.coalesce(F.nullif(own, F.lit("")), "vote").alias("category"))


@query("hp04_new_parents", "select concat('L2_N', substr(md5(child_id), 1, 8)) node_id, child_id from tree_parent_links_l4_to_l3 where parent_id is null or parent_id = '' group by child_id")
def hp04(spark, d):
    """Children without a parent get a created one, its id hashed from the member."""
    l = table(spark, d, "tree_parent_links_l4_to_l3").filter("parent_id is null or parent_id = ''").select("child_id").distinct()
    return l.select(T.node_id(F.lit(2), F.array("child_id")).alias("node_id"), "child_id")


@query("hp05_fold_categories", "select s.c_mktsegment label, coalesce(e.id, concat('L1_N', substr(md5(s.c_mktsegment), 1, 8))) id from (select distinct c_mktsegment from customer) s left join (select c_mktsegment, 'L1_old' id from customer where c_mktsegment like 'B%' group by 1) e on e.c_mktsegment = s.c_mktsegment")
def hp05(spark, d):
    names = table(spark, d, "customer").select(F.col("c_mktsegment").alias("label")).distinct()
    old = names.filter("label like 'B%'").withColumn("_id", F.lit("L1_old"))
    return names.join(old, "label", "left").select("label", F.coalesce("_id", F.concat(F.lit("L1_N"), F.substring(F.md5("label"), 1, 8))).alias("id"))


# joins by sample prefix --------------------------------------------------------------------------------

_ADM = "m as (select sample_id, split_part(sample_id, '_', 1) doc from policy_corpus_embeddings group by all), a as (select doc_id, min(l1) unit from seed_samples group by 1 union all select concat('DF', lpad((1000 + doc_id)::varchar, 7, '0')), min(admin_level) from documents where doc_id <= 200 group by 1)"


def _members(spark, d):
    m = table(spark, d, "policy_corpus_embeddings").select("sample_id").distinct().withColumn("doc", F.substring_index("sample_id", "_", 1))
    a = table(spark, d, "seed_samples").groupBy("doc_id").agg(F.min("l1").alias("unit"))
    b = table(spark, d, "documents").select(F.concat(F.lit("DF"), F.lpad((F.lit(1000) + F.col("doc_id")).cast("string"), 7, "0")).alias("doc_id"), "admin_level").groupBy("doc_id").agg(F.min("admin_level").alias("unit"))
    return m, a.unionByName(b)


_ADM = _ADM.replace(" where doc_id <= 200", "")


@query("jn05_sample_units", f"with {_ADM} select a.unit, count(*) n, count(*) filter (a.doc_id is null) missing from m left join a on a.doc_id = m.doc group by 1")
def jn05(spark, d):
    m, a = _members(spark, d)
    return m.join(a, F.col("doc") == F.col("doc_id"), "left").groupBy("unit").agg(F.count("*").alias("n"), F.count_if(F.col("doc_id").isNull()).alias("missing"))


@query("rp07_unit_summary", f"with {_ADM} select count(*) samples, count(distinct m.doc) docs, count(*) filter (a.doc_id is null) missing from m left join a on a.doc_id = m.doc")
def rp07(spark, d):
    m, a = _members(spark, d)
    return m.join(a, F.col("doc") == F.col("doc_id"), "left").agg(F.count("*").alias("samples"), F.count_distinct("doc").alias("docs"), F.count_if(F.col("doc_id").isNull()).alias("missing"))


@query("jn06_nodes_in_tree", "select node_id, count(*) n from node_scores where node_id in (select node_id from tree_nodes_l3) group by 1")
def jn06(spark, d):
    return table(spark, d, "node_scores").join(table(spark, d, "tree_nodes_l3").select("node_id").distinct(), "node_id", "left_semi").groupBy("node_id").agg(F.count("*").alias("n"))


@query("jn07_discards", "select distinct id_a from policy_similarity_rerank_edges e where not exists (select 1 from knn_probes k where k.sample_id = e.id_a)")
def jn07(spark, d):
    return table(spark, d, "policy_similarity_rerank_edges").select("id_a").distinct().join(table(spark, d, "knn_probes").select(F.col("sample_id").alias("id_a")), "id_a", "left_anti")


@query("jn14_units_without_members", f"with {_ADM} select a.doc_id from a where doc_id not in (select doc from m)")
def jn14(spark, d):
    m, a = _members(spark, d)
    return a.join(m.select(F.col("doc").alias("doc_id")).distinct(), "doc_id", "left_anti").select("doc_id")


@query("fl02_heading_filter", "select level, count(*) n from (select concat('H', cast(l_partkey % 6 as bigint)) as level, l_returnflag f from lineitem) where regexp_matches(level, '^H[1-4]$') and f = 'R' group by 1")
def fl02(spark, d):
    t = table(spark, d, "lineitem").select(F.concat(F.lit("H"), (F.col("l_partkey") % 6).cast("string")).alias("level"), F.col("l_returnflag").alias("f"))
    return t.filter(F.col("level").rlike("^H[1-4]$") & (F.col("f") == "R")).groupBy("level").agg(F.count("*").alias("n"))


@query("fl06_level_discard_category", "select distinct n.node_id from node_scores n where level = 'L3' and high_risk is not true and l1_label in (select l1_label from path_scores) and not exists (select 1 from tree_parent_links_l3_to_l2 l where l.child_id = n.node_id and l.decision = 'model_assign')")
def fl06(spark, d):
    n = table(spark, d, "node_scores").filter("level = 'L3' and high_risk is not true").select("node_id", "l1_label").distinct()
    gone = table(spark, d, "tree_parent_links_l3_to_l2").filter("decision = 'model_assign'").select(F.col("child_id").alias("node_id")).distinct()
    return n.join(table(spark, d, "path_scores").select("l1_label").distinct(), "l1_label", "left_semi").join(gone, "node_id", "left_anti").select("node_id").distinct()


@query("fl07_membership_discard", "select count(*) n from policy_corpus_embeddings where sample_id not in (select sample_id from knn_probes)")
def fl07(spark, d):
    p = table(spark, d, "knn_probes").select("sample_id").distinct()
    return table(spark, d, "policy_corpus_embeddings").join(p, "sample_id", "left_anti").agg(F.count("*").alias("n"))
