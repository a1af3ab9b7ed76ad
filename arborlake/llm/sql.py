"""SQL that must give the rows of the queries of the same name, where SQL can express them."""

import unicodedata

SQL: dict[str, str] = {}


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# Letters of other scripts drawn like a Latin letter, as the P3 oracle takes them. The
# operator has its look-alikes from another source.
LOOKALIKES = {
    # Cyrillic
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S", "Ԛ": "Q", "Ԝ": "W", "Ү": "Y",
    # Greek
    "ο": "o", "ϲ": "c", "ϳ": "j", "ν": "v",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    # Armenian, Latin variants
    "օ": "o", "ս": "u", "հ": "h", "ɡ": "g", "ɑ": "a",
    # hyphens and marks of one shape
    "‐": "-", "−": "-", "µ": "μ",
    # CJK radicals without a compatibility mapping
    "⻄": "西", "⻅": "见", "⻆": "角", "⻉": "贝", "⻋": "车", "⻓": "长", "⻔": "门", "⻘": "青", "⻙": "韦", "⻚": "页", "⻛": "风", "⻜": "飞",
    "⻢": "马", "⻥": "鱼", "⻦": "鸟", "⻨": "麦", "⻩": "黄", "⻬": "齐", "⻰": "龙", "⺠": "民",
}

# P3: characters are mapped one by one through tables of (character, replacement), then composed.
_INVISIBLE = r"[\x{00AD}\x{034F}\x{061C}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180F}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{3164}\x{FE00}-\x{FE0F}\x{FEFF}\x{FFA0}\x{FFF0}-\x{FFF8}\x{E0000}-\x{E0FFF}\x00-\x08\x0E-\x1F\x7F-\x84\x86-\x9F]"
_BLANK = r"[\t-\r \x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{2800}]"
#: Ranges whose compatibility characters look like the plain ones: signs, Roman numerals, radicals,
#: compatibility ideographs, ligatures, half and full width.
_PLAIN_RANGES = ((0x132, 0x133), (0x1C4, 0x1CC), (0x2011, 0x2011), (0x2160, 0x217F), (0x2E80, 0x2FD5), (0xF900, 0xFAD9), (0xFB00, 0xFB06), (0xFF01, 0xFFEE), (0x2F800, 0x2FA1D))
_SEEN_MAP = {c: "".join(LOOKALIKES.get(x, x) for x in unicodedata.normalize("NFKC", c)) for a, b in _PLAIN_RANGES for c in map(chr, range(a, b + 1))} | LOOKALIKES
_FOLD_MAP = {c: unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", c).casefold()) for c in map(chr, range(0x41, 0x30000)) if not 0xD800 <= ord(c) <= 0xDFFF}


def _values(name: str, table: dict[str, str]) -> str:
    return f"{name}(c, f) as (values " + ", ".join(f"({_quoted(c)}, {_quoted(f)})" for c, f in table.items() if c != f) + ")"


def _mapped(out: str, source: str, table: str) -> str:
    """out(x, y): every text x of source with its characters mapped through the table."""
    return f"""{out} as (select x, nfc_normalize(coalesce(string_agg(coalesce(f, ch), '' order by i), '')) y
  from (select x, unnest(string_split(v, '')) ch, unnest(range(len(v))) i from {source}) left join {table} on c = ch group by x)"""


_NODES = f"""
with n as (select node_id, arg_max(struct_pack(label := label, human_label := human_label), loaded_at) x
           from tree_nodes_l3 where node_id is not null group by node_id),
{_values("seen_map", _SEEN_MAP)}, {_values("fold_map", _FOLD_MAP)},
texts as (select distinct x, nfc_normalize(regexp_replace(regexp_replace(x, {_quoted(_INVISIBLE)}, '', 'g'), {_quoted(_BLANK)}, ' ', 'g')) v
          from (select x.label x from n union all select x.human_label from n) where x is not null),
{_mapped("seen", "texts", "seen_map")},
again as (select x, y v from seen), {_mapped("folded", "again", "fold_map")},
f as (select node_id, n.x.label label, n.x.human_label human_label,
             case when n.x.label is null then null else coalesce(a.y, '') end label_seen, case when n.x.human_label is null then null else coalesce(b.y, '') end human_label_seen,
             case when n.x.label is null then null else coalesce(c.y, '') end label_form, case when n.x.human_label is null then null else coalesce(d.y, '') end human_label_form
      from n left join seen a on a.x = n.x.label left join seen b on b.x = n.x.human_label
      left join folded c on c.x = n.x.label left join folded d on d.x = n.x.human_label)"""

SQL["p3_found"] = _NODES + " select node_id from f where label <> human_label and label_seen = human_label_seen"
SQL["p3_labels"] = _NODES + """
select node_id, label_form, human_label_form,
       case when label is null or human_label is null then 'missing' when label = human_label then 'none'
            when label_seen = human_label_seen then 'encoding' when label_form = human_label_form then 'style' else 'renamed' end change from f"""

_GROUPS = """
with recursive p as (
  select distinct least(id_a, id_b) u, greatest(id_a, id_b) v from policy_similarity_rerank_edges
  where rerank_score >= 0.55 and not isnan(rerank_score) and id_a <> id_b),
e as (select u a, v b from p union all select v, u from p),
r(id, g) as (select distinct a, a from e union select e.b, r.g from r join e on e.a = r.id where r.g < e.b),
grp as (select id sample_id, min(g) group_id from r group by id)"""
SQL["p5_found"] = _GROUPS + " select sample_id, group_id from grp"
SQL["p5_group_sizes"] = _GROUPS + """, s as (select group_id, count(*) group_size from grp group by 1)
select group_size, count(*) n_groups from s group by 1"""

SQL["p7_round_trip"] = "select doc_id, md5(coalesce(text, '')) text_md5 from documents"

_V = range(1, 6)
_GAP = {(a, b): f"pow({'+'.join(f't{g}' for g in range(a, b + 1))} - (t{a} + t{b}) / 2.0, 2)" for a in _V for b in _V if a < b}
SQL["p4_alpha"] = f"""
with n as (select sample_id, judge_key, arg_max(result.scores, scored_at) s from node_scores
           where sample_id is not null and judge_key is not null group by all),
l as (select sample_id, 'vertical_coherence' dimension, s.vertical_coherence x from n
      union all select sample_id, 'horizontal_coherence', s.horizontal_coherence from n
      union all select sample_id, 'label_quality', s.label_quality from n),
per as (select dimension, sample_id, count(*) n, {', '.join(f'count(*) filter (x = {v}) c{v}' for v in _V)}
        from l where x between 1 and 5 group by all having count(*) > 1),
t as (select dimension, count(*) n_items, sum(n)::double total, {', '.join(f'sum(c{v})::double t{v}' for v in _V)},
      {', '.join(f'sum(2.0::double * c{a} * c{b} / (n - 1)) o{a}{b}' for a, b in _GAP)} from per group by dimension)
select dimension, n_items, round(1 - (total - 1) * ({' + '.join(f'o{a}{b} * {g}' for (a, b), g in _GAP.items())})
       / ({' + '.join(f'2 * t{a} * t{b} * {g}' for (a, b), g in _GAP.items())}), 6) alpha from t"""

SQL["p2_exact"] = """
with e as (select vec_id, list_transform(embedding, lambda x: x::double) v from embeddings),
s as (select a.vec_id query_id, b.vec_id id, row_number() over (partition by a.vec_id order by list_cosine_similarity(a.v, b.v) desc, b.vec_id) r
      from e a join e b on a.vec_id % 20 = 0 and a.vec_id <> b.vec_id)
select query_id, cast(r as integer) rank, id from s where r <= 10"""
