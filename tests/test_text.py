import pytest
from pyspark.sql import functions as F

from arborlake.functions import json_text as J
from arborlake.functions import text as T


def column(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r.y for r in df.select("i", fn(F.col("x")).alias("y")).orderBy("i").collect()]


def test_scalars(spark):
    assert column(spark, ["Ａ１　b", None], T.half_width) == ["A1 b", None]
    assert column(spark, ["　a \t b ", ""], T.collapse_spaces) == ["a b", ""]
    assert column(spark, ["（一）总体", "3、目标", "第二章 保障", "(4)措施", "二、1)附"], T.strip_numbering) == ["总体", "目标", "保障", "措施", "附"]
    assert column(spark, ["方案（试行）", "若干措施实施方案", "实施方案若干措施"], T.strip_suffixes) == ["方案", "", "实施方案"]
    assert column(spark, ["重点任务：推进", "重点任务", "发展"], T.remove_slogan) == ["推进", "重点任务", "发展"]
    assert column(spark, ["通知", "总体方案", "长标题里的通知书", "", None], T.is_generic) == [True, True, False, False, False]
    assert column(spark, ["a/b:c", "  ", None], T.safe_file_name) == ["a_b_c", "UNKNOWN", "UNKNOWN"]
    assert column(spark, ["ROOT", "L3", "x", None], T.level_number) == [0, 3, 99, 99]
    assert column(spark, ["2.5", "0", "9", "x", None], T.rating) == [2, 1, 5, None, None]
    assert column(spark, ["block 12x3", "none", None], T.first_integer) == [12, 0, 0]


def test_clean_title(spark):
    got = column(spark, ["", None, "一、重点任务", "（二）促进航空货运实施方案", "3、a"], T.clean_title)
    assert [(r.title, r.reason) for r in got] == [("", "empty"), ("", "empty"), ("重点任务", "slogan_only"), ("推进航空货运", None), ("a", "too_short")]


def test_smart_cut(spark):
    long = "推进航空货运枢纽建设的配套政策研究工作"
    assert column(spark, ["短标题", long, "甲" * 30], lambda c: T.smart_cut(c, 12)) == ["短标题", "推进航空货运枢纽建设的", "甲" * 12]


def test_tokens_and_jaccard(spark):
    df = spark.createDataFrame([("货站 5G", "货站的5G"), (None, ""), ("a", None)], "a string, b string")
    got = [r.y for r in df.select(T.jaccard(T.tokens(F.col("a")), T.tokens(F.col("b"))).alias("y")).collect()]
    assert got == [1.0, 0.0, 0.0]


def test_python_scalars(spark):
    df = spark.createDataFrame([("abcd", "abce"), (None, "a")], "a string, b string")
    r, n = df.select(T.sequence_ratio("a", "b").alias("r"), T.display_units("a").alias("u")).collect()
    assert r.r == 0.75 and n.r is None and round(r.u, 2) == 2.24 and n.u == 0.0


@pytest.mark.parametrize("text,ok", [('{"a": 1}', True), ('```json\n{"a": 1}\n```', True), ('x {"a": "b}"} y', True), ('{"a": "say "hi" now"}', True), ("[1]", False), ("", False), (None, False), ('{"a": ', False)])
def test_parse_object(text, ok):
    value, error = J.parse_object(text)
    assert (value is not None) == ok and (error is None) == ok


def test_json_parts():
    assert J.balanced_object('x {"a": "}{"} {}') == '{"a": "}{"}' and J.balanced_object("{ {") is None and J.balanced_object("no") is None
    assert J.escape_inner_quotes('{"a": "b "c" d"}') == '{"a": "b \\"c\\" d"}'
