from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from arborlake.llm.visible import character_map, comparison_form, forms, lookalikes, unify_labels, visible_form

SAME = [("ＡＢＣ１２", "ABC12"), ("café", "café"), ("а", "a"), ("货站", "货​站"), ("a b", "a b"), ("a　b", "a b"), ("⽔", "水"), ("冷", "冷"), ("e‑CMR", "e-CMR"), ("ﬁle", "file"), ("Ε", "E"), ("é", "е́"), ("a­b", "ab"), ("ｶ", "カ")]
DIFFERENT = [("A", "a"), ("é", "e"), ("m²", "m2"), ("①", "1"), ("貨", "货"), ("ab", "a b"), ("a b", "a  b"), ("x。", "x"), ("a", "á"), ("【A】", "(A)"), ("O", "0")]


ONE_CASE = [("Straße Ａ", "STRASSE a"), ("m²①", "M21"), ("Δ", "δ"), ("貨", "貨")]


def test_pairs(spark):
    mapping = character_map(lookalikes(spark))
    for a, b in SAME:
        for one, other in zip(forms([a], mapping), forms([b], mapping)):
            assert one == other, (a, b)
    for a, b in DIFFERENT:
        (one,), _ = forms([a], mapping)
        (other,), _ = forms([b], mapping)
        assert one != other, (a, b)
    for a, b in ONE_CASE:
        assert forms([a], mapping)[1] == forms([b], mapping)[1], (a, b)


def test_lookalikes_come_from_the_table_by_rule(spark):
    alike = lookalikes(spark)
    assert len(alike) > 200 and alike["І"] == "I" and alike["о"] == "o" and alike["⻅"] == "见" and "б" not in alike and "I" not in alike


@settings(max_examples=200, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(max_size=30), max_size=4))
def test_idempotent_and_one_by_one(spark, texts):
    mapping = character_map(lookalikes(spark)) if not MAPPING else MAPPING
    MAPPING.update(mapping)
    seen, plain = forms(texts, mapping)
    assert forms(seen, mapping) == (seen, plain)
    assert [forms([t], mapping)[0][0] for t in texts] == seen and len(plain) == len(texts)


MAPPING: dict = {}


def test_column_nulls_empty_long(spark):
    long = "Ａ​" * 200_000
    df = spark.createDataFrame([(1, None), (2, ""), (3, long), (4, "Ａ"), (5, "Ａ")], "i int, s string")
    got = {r.i: r.f for r in df.select("i", visible_form("s", spark).alias("f")).collect()}
    assert got == {1: None, 2: "", 3: "A" * 200_000, 4: "A", 5: "A"}
    assert {r.i: r.f for r in df.select("i", comparison_form("s").alias("f")).collect()} == {1: None, 2: "", 3: "a" * 200_000, 4: "a", 5: "a"}


def test_unify_labels(spark):
    rows = [("n1", "Ａ", "A", 1, "z"), ("n1", "Ａ", "A", 1, "z"), ("n1", "old", "old", 0, "z"), ("n2", None, "", 1, "z"), (None, "a", "b", 1, "z")]
    df = spark.createDataFrame(rows, "node_id string, label string, human_label string, loaded_at int, label_form string")
    got = {r.node_id: (r.label_form, r.human_label_form, r.human_label_seen) for r in unify_labels(df).collect()}
    assert got == {"n1": ("a", "a", "A"), "n2": (None, "", "")}
    assert unify_labels(df.limit(0)).count() == 0
