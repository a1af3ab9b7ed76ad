"""Text scalars as Column expressions. Every function keeps null as null unless it says otherwise."""

from __future__ import annotations

import difflib
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Unicode white space for Java and RE2 alike.
WS = r"[\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
FULL_WIDTH = "".join(chr(c) for c in (0x3000, *range(0xFF01, 0xFF5F)))
HALF_WIDTH = "".join(chr(c) for c in (0x20, *range(0x21, 0x7F)))

# Word lists of the title rules.
TRUTHY = ("1", "y", "yes", "true", "是", "對", "对")
SLOGANS = ("重点任务", "主要任务", "工作举措", "组织实施", "总体要求", "发展目标", "总体思路", "基本原则", "总体部署", "工作安排", "工作目标", "总体目标与任务")
GENERIC_TITLES = (
    "重要举措", "若干举措", "若干措施", "工作方案", "工作举措", "主要任务", "主要举措", "方案", "工作任务", "通知", "意见", "工作要点",
    "组织实施", "有关事项", "实施细则", "实施意见", "实施方案", "重点任务", "工作要求", "总体要求", "基本原则", "保障措施",
)
SUFFIXES = ("（试行）", "(试行)", "（暂行）", "(暂行)", "实施方案", "工作方案", "若干措施")
NOTICE_TAILS = ("（试行）", "(试行)", "（通知）", "(通知)")
BOUNDARIES = (("的", 1), ("与", 0), ("和", 0), ("及", 0), ("或", 0), ("、", 0), ("等", 1), ("相关", 2))
PHRASE_VERBS = ("推进", "加强", "完善", "优化", "建设", "提升", "发展", "实施", "支持", "鼓励", "促进", "构建", "打造", "开展")
CUT_VERBS = PHRASE_VERBS + ("建立", "健全", "落实", "深化", "新设立", "新增", "新建")
STOPWORDS = ("的", "与", "及", "和", "及其", "等", "与否", "有关", "相关", "工作", "方面")
NUMBERING = (
    r"^[(（]?[一二三四五六七八九十百千]+[)）][、\s\x{3000}]*", r"^[一二三四五六七八九十百千]+、", r"^[0-9]+[.、)][\s\x{3000}]*",
    r"^[(（][0-9]+[)）]", r"^第[一二三四五六七八九十百千零〇]+[章节条][\s\x{3000}]*",
)
MACRO_WORDS = ("体系", "框架", "战略", "布局")
MESO_PREFIXES = ("完善", "提升", "加强", "优化", "统筹", "推进", "发展", "建设")


def strip(c: Column) -> Column:
    """Both ends without Unicode white space."""
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def truthy(c: Column) -> Column:
    """FL-01: flag text to boolean; null is false."""
    return F.coalesce(F.lower(strip(c)).isin(*TRUTHY), F.lit(False))


def half_width(c: Column) -> Column:
    """TX-01."""
    return F.translate(c, FULL_WIDTH, HALF_WIDTH)


def collapse_spaces(c: Column) -> Column:
    """TX-02."""
    return strip(F.regexp_replace(c, f"{WS}+", " "))


def keep_zh_alnum(c: Column) -> Column:
    """TX-03: CJK ideographs, ASCII letters and digits only; null becomes empty."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"[^\x{4e00}-\x{9fa5}A-Za-z0-9]", "")


def strip_numbering(c: Column) -> Column:
    """TX-04: five numbering patterns, each once, in order."""
    return strip(reduce(lambda t, p: F.regexp_replace(t, p, ""), NUMBERING, c))


def _quote(s: str) -> str:
    return "\\Q" + s + "\\E"


def strip_suffixes(c: Column, suffixes=SUFFIXES) -> Column:
    """TX-05: each suffix at most once, in list order."""
    return strip(reduce(lambda t, s: F.regexp_replace(t, _quote(s) + r"\z", ""), suffixes, c))


_SLOGAN = "^(" + "|".join(SLOGANS) + ")"


def slogan_of(c: Column) -> Column:
    """The first listed slogan the text starts with, or an empty text."""
    return F.regexp_extract(c, _SLOGAN, 1)


def remove_slogan(c: Column) -> Column:
    """TX-06: text without the first listed slogan it starts with; a text that is the slogan stays."""
    return F.when(slogan_of(c) == c, c).otherwise(F.regexp_replace(c, _SLOGAN + "[ ：:]*", ""))


def normalize_verbs(c: Column) -> Column:
    """TX-07."""
    return F.replace(F.replace(c, F.lit("促进"), F.lit("推进")), F.lit("推动"), F.lit("推进"))


def clean_title(c: Column) -> Column:
    """TX-08: struct(title, reason) with reason in empty, slogan_only, too_short or null."""
    t = strip_numbering(collapse_spaces(half_width(strip(c))))
    only = F.coalesce((slogan_of(t) == t) & (t != ""), F.lit(False))
    done = collapse_spaces(normalize_verbs(strip_suffixes(remove_slogan(t))))
    core = F.regexp_replace(keep_zh_alnum(done), "[0-9]", "")
    blank = c.isNull() | (c == "")
    return F.struct(
        F.when(blank, "").when(only, t).otherwise(done).alias("title"),
        F.when(blank, "empty").when(only, "slogan_only").when(F.length(core) < 2, "too_short").alias("reason"),
    )


def _last_before(s: Column, marker: str) -> Column:
    """Zero-based position of the last occurrence of marker, -1 without one."""
    back = F.instr(F.reverse(s), marker[::-1])
    return F.when(back > 0, F.length(s) - (back - 1) - len(marker)).otherwise(-1)


def smart_cut(c: Column, max_len: int) -> Column:
    """TX-09: cut at the first boundary word that leaves a verb phrase, else from the first listed
    verb, else hard. Texts within max_len only lose their marks."""
    s = keep_zh_alnum(c)
    window = F.substr(s, F.lit(1), F.lit(max_len + 5))
    tries = []
    for marker, keep in BOUNDARIES:
        at = _last_before(window, marker)
        cand = F.substr(s, F.lit(1), at + keep)
        verb = reduce(lambda a, b: a | b, [F.contains(cand, F.lit(v)) for v in PHRASE_VERBS])
        tries.append(F.when((at > 0) & F.length(cand).between(8, max_len) & verb, cand))
    for v in CUT_VERBS:
        at = F.instr(s, v)
        cand = F.substr(s, at, F.lit(max_len))
        tries.append(F.when((at > 0) & (F.length(cand) >= 8), cand))
    return F.when(F.length(s) <= max_len, s).otherwise(F.coalesce(*tries, F.substr(s, F.lit(1), F.lit(max_len))))


def simple_clean(c: Column) -> Column:
    """TX-10: the older cleaner: every generic prefix in turn, then notice tails; empty keeps the text."""
    t = reduce(lambda t, p: F.regexp_replace(t, f"^{p}[：: ，,]*", ""), GENERIC_TITLES, strip(c))
    t = reduce(lambda t, p: F.regexp_replace(t, "[：: ]*" + _quote(p) + r"\z", ""), NOTICE_TAILS, t)
    return F.when(t == "", c).otherwise(t)


def tokens(c: Column) -> Column:
    """TX-11: CJK characters, then alphanumeric runs, without stop words; null gives none."""
    s = F.coalesce(c, F.lit(""))
    both = F.concat(F.regexp_extract_all(s, F.lit(r"([\x{4e00}-\x{9fa5}])")), F.regexp_extract_all(s, F.lit("([A-Za-z0-9]+)")))
    return F.filter(both, lambda x: ~x.isin(*STOPWORDS))


def jaccard(a: Column, b: Column) -> Column:
    """TX-12: of two token arrays; 0 when both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """TX-13: similarity of two texts by their longest matching blocks; null where either is null."""
    same: dict[tuple, float] = {}
    out = []
    for x, y in zip(a, b):
        if x is None or y is None:
            out.append(None)
            continue
        if (x, y) not in same:
            same[x, y] = difflib.SequenceMatcher(None, x, y).ratio()
        out.append(same[x, y])
    return pd.Series(out, dtype="float64")


def first_integer(c: Column) -> Column:
    """TX-14: the first run of digits, 0 without one or when it is too large."""
    return F.coalesce(F.try_to_number(F.regexp_extract(c, "([0-9]{1,18})", 1), F.lit("9" * 18)).cast("long"), F.lit(0))


@F.pandas_udf(DoubleType())
def display_units(s: pd.Series) -> pd.Series:
    """TX-15: width with blanks .28, wide characters 1 and others .56; null is 0."""
    wide = lambda c: 0.28 if c.isspace() else 1.0 if unicodedata.east_asian_width(c) in "WFA" else 0.56
    codes, values = pd.factorize(s)
    each = [sum(map(wide, v)) for v in values] + [0.0]
    return pd.Series([each[k] for k in codes], dtype="float64")


def has_cjk(c: Column) -> Column:
    """TX-16 per row; a table's language is zh when any row has one."""
    return F.coalesce(c.rlike(r"[\x{4e00}-\x{9fff}]"), F.lit(False))


def range_list(c: Column) -> Column:
    """TX-17: "a-b" to the integers a..b; null for anything else or an empty range."""
    a, b = F.try_element_at(F.split(c, "-"), F.lit(1)).try_cast("int"), F.try_element_at(F.split(c, "-"), F.lit(2)).try_cast("int")
    return F.when(a <= b, F.sequence(a, F.greatest(a, b)))


def is_generic(c: Column, patterns=GENERIC_TITLES) -> Column:
    """FL-04: a generic heading: listed, or of at most 4 characters and containing a listed one."""
    t = strip(c)
    inside = reduce(lambda a, b: a | b, [F.contains(t, F.lit(p)) for p in patterns])
    return F.coalesce((t != "") & (t.isin(*patterns) | ((F.length(t) <= 4) & inside)), F.lit(False))


def should_skip(c: Column, keywords: tuple[str, ...] = ()) -> Column:
    """FL-03: empty, or starting with a keyword or slogan after the numbering is gone."""
    t = strip_numbering(strip(F.coalesce(c, F.lit(""))))
    return (strip(F.coalesce(c, F.lit(""))) == "") | reduce(lambda a, b: a | b, [t.startswith(p) for p in keywords + SLOGANS])


def text_for_embedding(title: Column, path: Column) -> Column:
    """PR-01: title [SEP] path, without empty parts; the text "nan" counts as empty."""
    part = lambda c: F.when(F.lower(strip(c)) != "nan", F.nullif(strip(c), F.lit("")))
    return F.concat_ws(" [SEP] ", part(title), part(path))


def safe_file_name(c: Column) -> Column:
    """IO-15."""
    t = F.regexp_replace(strip(F.regexp_replace(F.coalesce(c, F.lit("")), r'[<>:"/\\|?*\x00-\x1f]', "_")), f"{WS}+", "_")
    return F.when(t == "", "UNKNOWN").otherwise(t)


def level_number(c: Column) -> Column:
    """HP-07: ROOT 0, L{n} n, anything else 99."""
    return F.when(F.upper(c) == "ROOT", 0).otherwise(F.coalesce(F.regexp_extract(F.upper(F.coalesce(c, F.lit(""))), "^L([0-9]{1,6})$", 1).try_cast("int"), F.lit(99)))


def next_level(c: Column) -> Column:
    """HP-08: the level below, L4 at most."""
    return F.concat(F.lit("L"), F.least(level_number(c) + 1, F.lit(4)).cast("string"))


def padded(c: Column, width: int) -> Column:
    """Zero-filled text that is never cut."""
    s = c.cast("string")
    return F.when(F.length(s) >= width, s).otherwise(F.lpad(s, width, "0"))


def granularity(titles: Column) -> Column:
    """GR-12: macro, meso or micro by the words of the joined headings."""
    macro = reduce(lambda a, b: a | b, [F.contains(titles, F.lit(w)) for w in MACRO_WORDS])
    meso = reduce(lambda a, b: a | b, [titles.startswith(w) for w in MESO_PREFIXES])
    return F.when(macro, "macro").when(meso, "meso").otherwise("micro")


def granularity_confidence(g: Column) -> Column:
    """GR-12: confidence of the rule's answer."""
    return F.when(g == "micro", 0.6).otherwise(0.7)  # Fixed values


# Heading level to tier by granularity.
TIERS = {"macro": ("T1", "T2", "T3", "T4"), "meso": ("T2", "T3", "T4", "T4"), "micro": ("T3", "T4", "T4", "T4")}


def tier(granularity_: Column, level: Column) -> Column:
    """PR-02: tier of a heading level; unknown granularity counts as meso, unknown level gives T4."""
    g = F.lower(strip(F.coalesce(granularity_, F.lit(""))))
    g = F.when(g.isin(*TIERS), g).otherwise("meso")
    return F.coalesce(*[F.when((g == k) & (level == f"H{i + 1}"), F.lit(t)) for k, ts in TIERS.items() for i, t in enumerate(ts)], F.lit("T4"))


def rating(c: Column) -> Column:
    """JS-06: rounded half to even and held to 1..5; null and text that is no number stay null."""
    v = c.try_cast("double")
    return F.when(v.isNotNull() & ~F.isnan(v), F.greatest(F.lit(1), F.least(F.lit(5), F.bround(v).cast("int"))))


def node_id(level: Column, members: Column) -> Column:
    """L{d}_N and the first 8 digits of the md5 of the sorted distinct members."""
    return F.concat(F.lit("L"), level.cast("string"), F.lit("_N"), F.substring(F.md5(F.array_join(F.array_sort(F.array_distinct(members)), "|")), 1, 8))
