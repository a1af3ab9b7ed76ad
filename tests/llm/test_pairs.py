import numpy as np
import pytest

from arborlake.llm.answer_models import BUCKETS, LANGUAGES, LanguageModel, RefusalModel, grams
from arborlake.llm.pairs import clean, flag_pairs, instruction, is_copy, last_grams, mask, named_language, open_end, unwrap

ZH = "请比较「深化货站」与「推进平台」是否语义重复，输出JSON，包含 action、groups 与 reason。"
EN = 'Compare "Build Hall" with "Open Gate" and say whether they repeat each other. Explain in two sentences of plain text.'
GOOD_ZH = "二者的实施主体不同，不能简单合并，但可以设在同一上级之下。"
GOOD_EN = "The branch is too wide; grouping it by facilities makes it easier to read."
MORE_ZH = ["该分支过宽，按设施和数据归并后更便于浏览。", "保留当前结构即可，调整收益有限。", "上下位关系清楚，不需要桥接节点。", "抱歉地说，原有分组过粗，改为按设施划分后层次更均匀。"]
MORE_EN = ["Keep the present structure, since a change would bring little.", "The two labels deal with other measures, so they do not repeat each other.", "Sorry to lose the old grouping, but a split by data is more even.", "The parent cannot summarise the label directly, so a middle layer is needed."]

CASES = [
    (ZH, '{"action": "keep", "groups": [], "reason": "%s"}' % GOOD_ZH, None),
    (ZH, '```json\n{"action": "keep", "reason": "%s",}\n```' % GOOD_ZH, None),
    (EN, GOOD_EN, None), (EN, "Sorry to lose the old grouping, but a split by data is more even.", None),
    (ZH, "抱歉地说，原有分组过粗，改为按设施划分后层次更均匀。", None), (ZH, "保留当前结构即可，调整收益有限", None),
    (ZH, None, "empty"), (ZH, "", "empty"), (ZH, "​", "empty"), (ZH, "```json\n```", "empty"), (ZH, '{"action": "", "groups": [], "reason": ""}', "empty"), (ZH, "null", "empty"), (ZH, "...", "empty"), (ZH, "[]", "empty"),
    (ZH, ZH, "copy"), (ZH, "您的问题是：" + ZH, "copy"), (EN, "> " + EN, "copy"), (ZH, '{"reason": "%s"}' % ZH, "copy"),
    (ZH, "抱歉，我无法完成这一请求。", "refusal"), (ZH, '{"error": "该问题涉及敏感内容，暂不提供答复。"}', "refusal"), (EN, "I'm sorry, but I can't help with that request.", "refusal"), (EN, "Unfortunately I am not permitted to answer this.", "refusal"), (ZH, "恕我没有权限处理该请求，请咨询主管部门。", "refusal"),
    (ZH, "โครงสร้างปัจจุบันชัดเจนดีแล้ว", "other_language"), (ZH, GOOD_EN, "other_language"), (EN, GOOD_ZH, "other_language"), (ZH, "現在の構造で問題はなく、変更の効果は限定的です。", "other_language"), (EN, "La estructura actual es clara y un cambio aportaría poco.", "other_language"),
    (ZH + "请用英文回答。", GOOD_EN, None), (ZH + "请用英文回答。", GOOD_ZH, "other_language"),
    (ZH, '{"action": "keep", "groups": [], "reason": "二者的实施', "truncated"), (ZH, '{"action": "keep", "groups": [', "truncated"), (ZH, "二者的实施主体不同，不能简单合并，但可以设在同一上", "truncated"), (ZH, "该分支过宽，按设施…", "truncated"), (EN, "The branch is too wide; grouping it by facilities makes it easier to re", "truncated"),
]




@pytest.fixture(scope="module")
def log():
    rows = [(1000 + i, ZH, a + b) for i, (a, b) in enumerate((a, b) for a in [GOOD_ZH, *MORE_ZH] for b in [GOOD_ZH, *MORE_ZH] for _ in range(4))]
    return rows + [(2000 + i, EN, a + " " + b) for i, (a, b) in enumerate((a, b) for a in [GOOD_EN, *MORE_EN] for b in [GOOD_EN, *MORE_EN] for _ in range(4))]


def test_cases_and_evidence(spark, log):
    rows = log + [(i, p, r) for i, (p, r, _) in enumerate(CASES)]
    found = flag_pairs(spark.createDataFrame(rows, "response_id long, prompt string, raw string"), "response_id", "prompt", "raw", "1").collect()
    got = {r.response_id: r.defect for r in found}
    assert {CASES[i][:2]: got.get(i) for i in range(len(CASES))} == {(p, r): d for p, r, d in CASES}
    assert all(i < 1000 for i in got)
    evidence = [r.evidence for r in found if r.defect == "truncated"]
    prose = sum("{" not in (r or "") for _, r, d in CASES if d == "truncated")
    assert evidence.count("likelihood") == prose > 0  # all prose that breaks off is told by the likelihood


def test_parts():
    assert open_end('{"a": "b') == (True, 1) and open_end('{"a": [1]}') == (False, 0)
    assert unwrap('好的。\n{"action": "keep", "reason": "x。"}')["prose"] == "x。"
    assert named_language(ZH) is None and named_language(ZH + "（说明文字使用英语）") == "en"
    assert clean(None) == "" and last_grams("到此为止。") is None and last_grams("按「设施」")[-1] == "按\N{REPLACEMENT CHARACTER}" and last_grams("按「设")[-1] == "「设"
    assert is_copy("> " + EN, EN) and not is_copy(GOOD_EN, EN) and is_copy("短", "短") and not is_copy("", EN)


def test_models():
    model = LanguageModel()
    for text, want in ((ZH, "zh"), (EN, "en"), ("現在の構造で問題はありません。", "ja"), ("La estructura actual es clara.", "es"), ("النص واضح", None)):
        best = int(model.scores([instruction(mask(text))])[0].argmax())
        assert (LANGUAGES[best] if best < len(LANGUAGES) else None) == want
    texts = ["我们 ab", "", "x\x00y", "ab"]
    b, o = grams(texts, (1, 2))
    for i, t in enumerate(texts):  # a text's n-grams do not depend on its neighbours
        alone, _ = grams([t], (1, 2))
        assert sorted(b[o == i]) == sorted(alone)
    r = RefusalModel(np.zeros(BUCKETS))
    assert r.scores(["I'm sorry, but I can't help with that."])[0] > 20 > r.scores([GOOD_EN])[0]


def test_frame(spark):
    rows = [(i, ZH, GOOD_ZH, 1, "p") for i in range(20)] + [(0, ZH, GOOD_ZH, 1, "p"), (99, ZH, None, 1, "p"), (99, ZH, GOOD_ZH, 0, "p"), (None, ZH, "", 1, "p"), (98, None, "货站" * 50_000 + "。", 1, "p"), (97, ZH, "二者的实施主体不同，不能简单", 2, "p")]
    df = spark.createDataFrame(rows, "response_id long, prompt string, raw string, ts int, defect string")
    got = {r.response_id: r.defect for r in flag_pairs(df, "response_id", "prompt", "raw", "ts").collect()}
    assert got == {99: "empty", 97: "truncated"}
    assert flag_pairs(df.limit(0), "response_id", "prompt", "raw", "ts").count() == 0
