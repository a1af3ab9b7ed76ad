"""Text and predicate operators over the documents' titles, dressed with numbering and suffixes."""

from pyspark.sql import functions as F

from arborlake.functions import text as T
from arborlake.plans import query
from arborlake.runtime import table


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_list(xs) -> str:
    return "[" + ", ".join(map(q, xs)) + "]"


_LEAD = ("", "（一）", "3、", "第二章 ", "总体要求：", "　", "重点任务", "(4)")
_TAIL = ("", "（试行）", "实施方案", "　２０２４　促进行动", "与推动")


def heads(spark, d):
    """(doc_id, x, title): titles with varied leads and tails; about 1 in 37 is null."""
    lead = F.element_at(F.array(*map(F.lit, _LEAD)), (F.col("doc_id") % len(_LEAD) + 1).cast("int"))
    tail = F.element_at(F.array(*map(F.lit, _TAIL)), (F.col("doc_id") % len(_TAIL) + 1).cast("int"))
    docs = table(spark, d, "documents").select("doc_id", "title", "source", "admin_level", "text")
    return docs.withColumn("x", F.when(F.col("doc_id") % 37 != 0, F.concat(lead, F.coalesce("title", F.lit("")), tail)))


HEADS = f"""with h as (select doc_id, title, source, admin_level, text,
 case when doc_id % 37 <> 0 then concat(list_extract({sql_list(_LEAD)}, cast(doc_id % {len(_LEAD)} + 1 as bigint)), coalesce(title, ''),
 list_extract({sql_list(_TAIL)}, cast(doc_id % {len(_TAIL)} + 1 as bigint))) end x from documents) """


def s_strip(x):
    return f"regexp_replace({x}, {q(f'^{T.WS}+|{T.WS}+$')}, '', 'g')"


def s_half(x):
    return f"translate({x}, {q(T.FULL_WIDTH)}, {q(T.HALF_WIDTH)})"


def s_spaces(x):
    return s_strip(f"regexp_replace({x}, {q(T.WS + '+')}, ' ', 'g')")


def s_keep(x):
    return f"regexp_replace(coalesce({x}, ''), '[^\\x{{4e00}}-\\x{{9fa5}}A-Za-z0-9]', '', 'g')"


def s_numbering(x):
    for p in T.NUMBERING:
        x = f"regexp_replace({x}, {q(p)}, '')"
    return s_strip(x)


# each step is a column of its own, so that the SQL stays short
_STEPS = HEADS + f""",
a as (select *, {s_numbering(s_spaces(s_half(s_strip('x'))))} t from h),
b as (select *, case {' '.join(f"when starts_with(t, {q(s)}) then {q(s)}" for s in T.SLOGANS)} end hit from a),
c as (select *, case when hit is null or hit = t then t else regexp_replace(substr(t, length(hit) + 1), '^[ ：:]+', '') end u from b)"""
_CHAIN = _STEPS
_last = "u"
for _i, _s in enumerate(T.SUFFIXES):
    _CHAIN += f", d{_i} as (select *, case when ends_with({_last}, {q(_s)}) then substr({_last}, 1, length({_last}) - {len(_s)}) else {_last} end v{_i} from {'c' if _i == 0 else f'd{_i - 1}'})"
    _last = f"v{_i}"
_CHAIN += f", e as (select *, {s_spaces(f'replace(replace({s_strip(_last)}, {q(chr(0x4FC3) + chr(0x8FDB))}, {q(chr(0x63A8) + chr(0x8FDB))}), {q(chr(0x63A8) + chr(0x52A8))}, {q(chr(0x63A8) + chr(0x8FDB))})')} w from d{len(T.SUFFIXES) - 1})"


def _suffix_sql(x, suffixes):
    sql, last = HEADS, x
    for i, s in enumerate(suffixes):
        sql += f", s{i} as (select *, case when ends_with({last}, {q(s)}) then substr({last}, 1, length({last}) - {len(s)}) else {last} end v{i} from {'h' if i == 0 else f's{i - 1}'})"
        last = f"v{i}"
    return sql, last, f"s{len(suffixes) - 1}"


def scalar(name, fn, sql, prefix=HEADS, source="h"):
    """Register a query of one computed column over the dressed titles."""

    @query(name, f"{prefix} select doc_id, {sql} as y from {source}")
    def run(spark, d):
        return heads(spark, d).select("doc_id", fn(F.col("x")).alias("y"))

    return run


scalar("tx01_half_width", T.half_width, s_half("x"))
scalar("tx02_collapse_spaces", T.collapse_spaces, s_spaces("x"))
scalar("tx03_keep_zh_alnum", T.keep_zh_alnum, s_keep("x"))
scalar("tx04_strip_numbering", T.strip_numbering, s_numbering("x"))
_p, _l, _src = _suffix_sql("x", T.SUFFIXES)
scalar("tx05_strip_suffixes", T.strip_suffixes, s_strip(_l), _p, _src)
scalar("tx06_remove_slogan", lambda x: T.remove_slogan(T.strip_numbering(T.collapse_spaces(T.half_width(T.strip(x))))), "u", _STEPS, "c")
scalar("tx07_normalize_verbs", T.normalize_verbs, "replace(replace(x, '促进', '推进'), '推动', '推进')")
scalar("tx14_first_integer", lambda x: T.first_integer(F.translate(x, T.FULL_WIDTH, T.HALF_WIDTH)), f"coalesce(try_cast(nullif(regexp_extract({s_half('x')}, '([0-9]{{1,18}})', 1), '') as bigint), 0)")
scalar("io15_safe_file_name", T.safe_file_name, f"coalesce(nullif(regexp_replace({s_strip(f'''regexp_replace(coalesce(x, ''), '[<>:{chr(34)}/\\\\|?*\\x00-\\x1f]', '_', 'g')''')}, {q(T.WS + '+')}, '_', 'g'), ''), 'UNKNOWN')")


@query("tx08_clean_title", _CHAIN + f"""
select doc_id, case when x is null or x = '' then '' when hit = t then t else w end title,
 case when x is null or x = '' then 'empty' when hit = t then 'slogan_only' when length(regexp_replace({s_keep('w')}, '[0-9]', '', 'g')) < 2 then 'too_short' end reason from e""")
def tx08(spark, d):
    return heads(spark, d).select("doc_id", T.clean_title(F.col("x")).alias("r")).select("doc_id", "r.title", "r.reason")


_MAX = 12
_TRY = []
for _m, _k in T.BOUNDARIES:
    _at = f"(length(win) - (strpos(reverse(win), {q(_m[::-1])}) - 1) - {len(_m)})"
    _cand = f"substr(s, 1, cast({_at} + {_k} as bigint))"
    _TRY.append(f"case when strpos(reverse(win), {q(_m[::-1])}) > 0 and {_at} > 0 and length({_cand}) between 8 and {_MAX} and regexp_matches({_cand}, {q('|'.join(T.PHRASE_VERBS))}) then {_cand} end")
for _v in T.CUT_VERBS:
    _TRY.append(f"case when strpos(s, {q(_v)}) > 0 and length(substr(s, strpos(s, {q(_v)}), {_MAX})) >= 8 then substr(s, strpos(s, {q(_v)}), {_MAX}) end")


@query("tx09_smart_cut", HEADS + f", k as (select doc_id, {s_keep('x')} s, substr({s_keep('x')}, 1, {_MAX + 5}) win from h) select doc_id, case when length(s) <= {_MAX} then s else coalesce({', '.join(_TRY)}, substr(s, 1, {_MAX})) end y from k")
def tx09(spark, d):
    return heads(spark, d).select("doc_id", T.smart_cut(F.col("x"), _MAX).alias("y"))


_SIMPLE = s_strip("x")
for _g in T.GENERIC_TITLES:
    _SIMPLE = f"regexp_replace({_SIMPLE}, '^{_g}[：: ，,]*', '')"
for _n in T.NOTICE_TAILS:
    _SIMPLE = f"regexp_replace({_SIMPLE}, '[：: ]*[{_n[0]}]{_n[1:-1]}[{_n[-1]}]$', '')"


@query("tx10_simple_clean", HEADS + f", s as (select doc_id, x, {_SIMPLE} y from h) select doc_id, case when y = '' then x else y end y from s")
def tx10(spark, d):
    return heads(spark, d).select("doc_id", T.simple_clean(F.col("x")).alias("y"))


def s_tokens(x):
    return f"list_filter(list_concat(regexp_extract_all(coalesce({x}, ''), '[\\x{{4e00}}-\\x{{9fa5}}]'), regexp_extract_all(coalesce({x}, ''), '[A-Za-z0-9]+')), lambda z: not list_contains({sql_list(T.STOPWORDS)}, z))"


@query("tx11_tokens", HEADS + f"select doc_id, array_to_string({s_tokens('x')}, '|') y, cast(len({s_tokens('x')}) as integer) n from h")
def tx11(spark, d):
    t = T.tokens(F.col("x"))
    return heads(spark, d).select("doc_id", F.array_join(t, "|").alias("y"), F.size(t).alias("n"))


@query("tx12_jaccard", HEADS + f", t as (select doc_id, list_distinct({s_tokens('title')}) a, list_distinct({s_tokens('x')}) b from h) select doc_id, round(case when len(a) + len(b) = 0 then 0.0::double else len(list_intersect(a, b))::double / (len(a) + len(b) - len(list_intersect(a, b))) end, 6) y from t")
def tx12(spark, d):
    return heads(spark, d).select("doc_id", F.round(T.jaccard(T.tokens(F.col("title")), T.tokens(F.col("x"))), 6).alias("y"))


@query("tx13_sequence_ratio")
def tx13(spark, d):
    """Titles whose dressed form repeats them (ratio over 0.6)."""
    r = T.sequence_ratio(F.lower("title"), F.lower("x"))
    return heads(spark, d).select("doc_id", F.round(r, 6).alias("ratio")).withColumn("repetitive", F.col("ratio") > 0.6)


@query("tx15_display_units")
def tx15(spark, d):
    return heads(spark, d).select("doc_id", F.round(T.display_units(F.col("x")), 2).alias("units"))


@query("tx16_language", "select source, case when bool_or(regexp_matches(coalesce(title, ''), '[\\x{4e00}-\\x{9fff}]')) then 'zh' else 'en' end lang from documents group by source")
def tx16(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.when(F.bool_or(T.has_cjk(F.col("title"))), "zh").otherwise("en").alias("lang"))


@query("tx17_range_list", "select l_orderkey, l_linenumber, list_sum(range(cast(l_linenumber as bigint), cast(l_linenumber + l_quantity as bigint) + 1))::bigint total, cast(len(range(cast(l_linenumber as bigint), cast(l_linenumber + l_quantity as bigint) + 1)) as integer) n from lineitem")
def tx17(spark, d):
    li = table(spark, d, "lineitem").withColumn("r", F.concat_ws("-", F.col("l_linenumber").cast("int"), (F.col("l_linenumber") + F.col("l_quantity")).cast("int")))
    r = T.range_list(F.col("r"))
    return li.select("l_orderkey", "l_linenumber", F.aggregate(r, F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.size(r).alias("n"))


@query("fl01_truthy", f"select vec, count(*) n from (select list_contains({sql_list(T.TRUTHY)}, lower({s_strip('f')})) vec from (select list_extract([' Yes ', '否', '1', 'TRUE', '对', 'n', '是', ''], cast(doc_id % 8 + 1 as bigint)) f from documents)) group by vec")
def fl01(spark, d):
    flags = F.array(*map(F.lit, (" Yes ", "否", "1", "TRUE", "对", "n", "是", "")))
    f = table(spark, d, "documents").select(F.element_at(flags, (F.col("doc_id") % 8 + 1).cast("int")).alias("f"))
    return f.groupBy(T.truthy(F.col("f")).alias("vec")).agg(F.count("*").alias("n"))


@query("fl03_should_skip", HEADS + f", t as (select doc_id, {s_strip('''coalesce(x, '')''')} b, {s_numbering(s_strip('''coalesce(x, '')'''))} t from h) select doc_id, b = '' or {' or '.join(f'starts_with(t, {q(s)})' for s in ('附件',) + T.SLOGANS)} skip from t")
def fl03(spark, d):
    return heads(spark, d).select("doc_id", T.should_skip(F.col("x"), ("附件",)).alias("skip"))


@query("fl04_generic_title", "select sample_id, coalesce(" + s_strip("title") + f" <> '' and (list_contains({sql_list(T.GENERIC_TITLES)}, {s_strip('title')}) or (length({s_strip('title')}) <= 4 and ({' or '.join(f'contains(title, {q(p)})' for p in T.GENERIC_TITLES)}))), false) is_t0 from seed_samples")
def fl04(spark, d):
    return table(spark, d, "seed_samples").select("sample_id", T.is_generic(F.col("title")).alias("is_t0"))


@query("fl05_non_empty_text", "select source, count(*) n from documents where coalesce(" + s_strip("text") + ", '') <> '' group by source")
def fl05(spark, d):
    return table(spark, d, "documents").filter(F.coalesce(T.strip(F.col("text")), F.lit("")) != "").groupBy("source").agg(F.count("*").alias("n"))


@query("fl08_row_limit", "select doc_id, title from documents order by doc_id limit 100")
def fl08(spark, d):
    """A limit after an explicit order: the limit is the operator."""
    return table(spark, d, "documents").orderBy("doc_id").select("doc_id", "title").limit(100)


@query("fl09_mark_only", "select is_t0, count(*) n from (select " + f"coalesce(list_contains({sql_list(T.GENERIC_TITLES)}, title), false) or coalesce(length(title) <= 4 and ({' or '.join(f'contains(title, {q(p)})' for p in T.GENERIC_TITLES)}), false) is_t0 from (select {s_strip('title')} title from seed_samples)) group by is_t0")
def fl09(spark, d):
    marked = table(spark, d, "seed_samples").withColumn("is_t0", T.is_generic(F.col("title")))
    return marked.groupBy("is_t0").agg(F.count("*").alias("n"))


def _part(x):
    return f"case when lower({s_strip(x)}) <> 'nan' then nullif({s_strip(x)}, '') end"


_SPLIT = "split_part(text_for_embed, ' [SEP] ', {})"


@query("pr01_text_for_embedding", f"select sample_id, max(concat_ws(' [SEP] ', {_part(_SPLIT.format(1))}, {_part(_SPLIT.format(2))})) y from policy_corpus_embeddings group by sample_id")
def pr01(spark, d):
    t = table(spark, d, "policy_corpus_embeddings")
    part = lambda k: F.split_part("text_for_embed", F.lit(" [SEP] "), F.lit(k))
    return t.groupBy("sample_id").agg(F.max(T.text_for_embedding(part(1), part(2))).alias("y"))


_TIER = " ".join(f"when g = '{k}' and h = 'H{i + 1}' then '{t}'" for k, ts in T.TIERS.items() for i, t in enumerate(ts))


@query("pr02_tier", f"select g, h, y, count(*) n from (select g, h, case {_TIER} else 'T4' end y from (select list_extract(['macro', 'meso', 'micro'], cast(doc_id % 3 + 1 as bigint)) g, concat('H', cast(doc_id % 5 + 1 as bigint)) h from documents)) group by all")
def pr02(spark, d):
    t = table(spark, d, "documents").select(
        F.element_at(F.array(*map(F.lit, T.TIERS)), (F.col("doc_id") % 3 + 1).cast("int")).alias("g"), F.concat(F.lit("H"), (F.col("doc_id") % 5 + 1).cast("string")).alias("h")
    )
    return t.withColumn("y", T.tier(F.col("g"), F.col("h"))).groupBy("g", "h", "y").agg(F.count("*").alias("n"))


@query("pr03_level_override", """
with e as (select issuer_id, max(doc_id) doc_id, 'T1' lvl from documents where issuer_id is not null group by issuer_id)
select d.doc_id, coalesce(e.lvl, case when d.admin_level = 'province' then 'T2' else 'T3' end) tier from documents d left join e on e.issuer_id = d.issuer_id and e.doc_id = d.doc_id""")
def pr03(spark, d):
    """Exceptions by (issuer, document) override the level rule."""
    docs = table(spark, d, "documents")
    exceptions = docs.filter("issuer_id is not null").groupBy("issuer_id").agg(F.max("doc_id").alias("doc_id")).withColumn("lvl", F.lit("T1"))
    rule = F.when(F.col("admin_level") == "province", "T2").otherwise("T3")
    return docs.join(exceptions, ["issuer_id", "doc_id"], "left").select("doc_id", F.coalesce("lvl", rule).alias("tier"))


@query("pr04_reorder_columns", "select doc_id, coalesce(admin_level, '') level_origin, coalesce(lang, '') lang, coalesce(source, '') source from documents")
def pr04(spark, d):
    from arborlake.operators.reshape import insert_origin

    docs = table(spark, d, "documents").select("doc_id", "admin_level", "lang", "source").withColumn("level_origin", F.col("admin_level"))
    return insert_origin(docs, "admin_level", "level_origin").drop("admin_level")


@query("hp07_level_number", "select level, case when upper(level) = 'ROOT' then 0 else coalesce(try_cast(nullif(regexp_extract(upper(coalesce(level, '')), '^L([0-9]{1,6})$', 1), '') as integer), 99) end n, count(*) c from tree_nodes_l3 group by all")
def hp07(spark, d):
    return table(spark, d, "tree_nodes_l3").groupBy("level", T.level_number(F.col("level")).alias("n")).agg(F.count("*").alias("c"))


@query("hp08_next_level", "select level, concat('L', least(coalesce(try_cast(nullif(regexp_extract(upper(coalesce(level, '')), '^L([0-9]{1,6})$', 1), '') as integer), 99) + 1, 4)) y, count(*) c from node_scores group by level")
def hp08(spark, d):
    return table(spark, d, "node_scores").groupBy("level", T.next_level(F.col("level")).alias("y")).agg(F.count("*").alias("c"))


@query("js06_rating", "select vec_id, case when v is not null then greatest(1, least(5, cast(round_even(v, 0) as integer))) end y from (select vec_id, cast(label as double) * 0.5::double - 0.5::double v from embeddings)")
def js06(spark, d):
    e = table(spark, d, "embeddings")
    return e.select("vec_id", T.rating(F.col("label").cast("double") * 0.5 - 0.5).alias("y"))


@query("ma01_math", "select l_orderkey, l_linenumber, round_even(l_extendedprice / 1000, 0) r, ceil(l_quantity * 0.3::double) c, floor(l_quantity * 0.1::double) f, greatest(0.6::double, least(1.0::double, l_discount * 20)) clip, round(case when l_tax <> 0 then l_discount / l_tax end, 6) ratio, round(cos(radians(l_quantity)), 6) x, round(sin(radians(l_quantity)), 6) y from lineitem")
def ma01(spark, d):
    li = table(spark, d, "lineitem")
    c = F.col
    return li.select(
        "l_orderkey", "l_linenumber", F.bround(c("l_extendedprice") / 1000).alias("r"), F.ceil(c("l_quantity") * 0.3).cast("double").alias("c"), F.floor(c("l_quantity") * 0.1).cast("double").alias("f"),
        F.greatest(F.lit(0.6), F.least(F.lit(1.0), c("l_discount") * 20)).alias("clip"), F.round(F.try_divide("l_discount", "l_tax"), 6).alias("ratio"),
        F.round(F.cos(F.radians("l_quantity")), 6).alias("x"), F.round(F.sin(F.radians("l_quantity")), 6).alias("y"),
    )


@query("dt01_epoch_and_version", "select event_id, cast(floor(epoch(ts)) as bigint) epoch, strftime(ts, '%Y%m%d%H%M') version from events")
def dt01(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.select("event_id", F.unix_timestamp("ts").alias("epoch"), F.date_format("ts", "yyyyMMddHHmm").alias("version"))
