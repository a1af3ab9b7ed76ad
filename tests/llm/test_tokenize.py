import base64
import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from arborlake.llm import tokenize as T

pytestmark = pytest.mark.skipif(not os.path.exists(f"{T.TOKENIZER_DIR}/byte_bpe_50k.tiktoken"), reason="no vocabulary")


@pytest.fixture(scope="module")
def coder():
    return T.BytePairEncoder(T._model("byte_bpe_50k", None))


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    with open(f"{T.TOKENIZER_DIR}/byte_bpe_50k.tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=T.PRETOKEN, mergeable_ranks=ranks, special_tokens={})


TEXTS = ["", " ", "Hello world's  tests\n\n  ok", "航空货运<|endoftext|>é​", "a" * 5000, "\x00ÿ tail", "👨‍🌾 123 4567", "  lead"]


def test_same_ids_and_round_trip(coder, reference):
    got = coder.encode_batch([*TEXTS, None])
    assert got[:-1] == [reference.encode_ordinary(t) for t in TEXTS] and got[-1] == []
    assert [coder.decode(g) for g in got[:-1]] == TEXTS


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=("Cs",)), max_size=60))
def test_any_text(coder, reference, text):
    assert coder.encode_batch([text]) == [reference.encode_ordinary(text)]
    assert coder.decode(coder.encode_batch([text])[0]) == text


def test_frames(spark):
    long = "货站 word " * 30_000
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "ab", 0), (3, "ab", 0), (4, long, 0)], "doc_id long, text string, ids int")
    rows = T.encode_texts(df, "doc_id").collect()
    assert sorted((r.doc_id, r.n_tokens) for r in rows)[:2] == [(1, 0), (2, 0)] and len(rows) == 5
    assert all(r.ids == [] for r in rows if r.doc_id < 3)
    back = {r.doc_id: r.text for r in T.decode_ids(T.encode_texts(df, "doc_id"), "doc_id").collect()}
    assert back == {1: "", 2: "", 3: "ab", 4: long}
    assert T.encode_texts(df.limit(0), "doc_id").count() == 0
    cut = spark.createDataFrame([(1, coder_ids("货")[:1]), (2, None)], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in T.decode_ids(cut, "doc_id").collect()} == {1: "\N{REPLACEMENT CHARACTER}", 2: None}


def coder_ids(text):
    return T.BytePairEncoder(T._model("byte_bpe_50k", None)).encode_batch([text])[0]
