import random
import textwrap

import numpy as np
import pytest

from arborlake.llm import reading as R

WORDS = {b: [f"{p}{b}{s}" for p in ("ka", "lo", "mi", "tu") for s in ("ba", "ne", "so")] for b in "12345"}


def word(b, k):
    return "abcdefghij"[int(b)] + WORDS[b][k].translate(str.maketrans("12345", "vwxyz"))


def sentence(rng, b):
    return " ".join(word(str(b), rng.randrange(12)) for _ in range(rng.randint(3, 4 + b))) + "."


def passage(rng, b, n=10, noise=0.2):
    return " ".join(sentence(rng, b if rng.random() > noise else min(5, max(1, b + rng.choice((-1, 1))))) for _ in range(n))


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(1)
    ex = spark.createDataFrame([(passage(rng, b), b) for b in range(1, 6) for _ in range(8)] + [(None, 1), ("x", None)], "text string, reading_band int")
    truth = {i: rng.randint(1, 5) for i in range(300)}
    docs = [(i, passage(rng, b), "x") for i, b in truth.items()]
    return ex, truth, docs


def test_bands_of_new_texts(spark, tables):
    ex, truth, docs = tables
    odd = [(1000, None, "x"), (1001, "", "x"), (1002, " 　\n", "x"), (1003, "!!! 123", "x"), (1004, passage(random.Random(3), 4, 20_000), "x"), (1005, docs[0][1], "x"), (1005, docs[0][1], "x")]
    df = spark.createDataFrame(docs + odd, "doc_id long, text string, reading_band string")
    rows = R.reading_bands(df, ex).collect()
    got = {r.doc_id: r.reading_band for r in rows}
    assert np.mean([got[i] == b for i, b in truth.items()]) > 0.95
    assert not {1000, 1001, 1002} & set(got) and got[1003] == 3 and got[1004] == 4 and sum(r.doc_id == 1005 for r in rows) == 2


def test_empty(spark, tables):
    assert R.reading_bands(spark.createDataFrame([], "doc_id long, text string"), tables[0]).count() == 0


def test_held_out_passages_rank(tables):
    rng = random.Random(9)
    texts = [passage(rng, b) for b in range(1, 6) for _ in range(12)]
    band = np.repeat(np.arange(1, 6), 12)
    c = R.clauses(texts)
    x = R.hashed(c, len(texts))
    train = np.arange(60) % 3 != 0
    w = R.fit_ranker(x[train], band[train], np.zeros(train.sum()))
    s, y = (x @ w)[~train], band[~train]
    right = [(s[i] > s[j]) for i in range(len(y)) for j in range(len(y)) if y[i] > y[j]]
    assert np.mean(right) > 0.95


def test_isotonic():
    x, y = R.isotonic(np.array([1.0, 2, 3, 4]), np.array([1, 3, 2, 4]))
    assert (np.diff(y) >= 0).all() and y.tolist() == [1, 2.5, 4]


def test_clauses():
    c = R.clauses(["Go home, now. 停车场；关门。", "", "One"])
    assert c.doc.tolist() == [0, 0, 0, 0, 2] and c.initial.tolist() == [True, False, True, True, True]


def test_wrapped_texts_are_whole():
    en = "Build A Network\nRef. BRI/2029/0395-B\n" + "Support will be given to district offices that open regular services before September, and then progress was slow. " * 4
    zh = "支持培训应用\n澹屏港函〔2033〕97号\n" + "小明把苹果放到车上，我喜欢篮子。姐姐和农民坐在桥头等车回家吃午饭。" * 5
    for text, width in ((en, 70), (zh, 38), (zh, 25)):
        flat = "\n".join(text[i : i + width] for i in range(0, len(text), width))
        assert R.plain(flat) == R.plain(text) and len(R.plain(text)) >= len(text) - 2
    body = " ".join(f"The council of place number {i} chose to move the parking area" for i in range(20)) + "."
    head = "Build A Network\x01\nRef. 12\x01\n"
    assert R.plain("Build A Network\nRef. 12\n" + "\n".join(textwrap.wrap(body, 60))) == head + body
    notice = R.plain("Build A Network\nRef. 12\nBuses run.\n5 November 2034")
    assert notice == head + "Buses run.\n5 November 2034\x01"
    assert R.clauses([notice]).fragment.tolist() == [True, True, False, True]  # no word is left out


def test_wrapping_keeps_the_band(spark, tables):
    ex, truth, docs = tables
    wrap = [(i, "\n".join(t[k : k + 70] for k in range(0, len(t), 70))) for i, t, _ in docs]
    got = {r.doc_id: r.reading_band for r in R.reading_bands(spark.createDataFrame(wrap, "doc_id long, text string"), ex).collect()}
    plain = {r.doc_id: r.reading_band for r in R.reading_bands(spark.createDataFrame(docs, "doc_id long, text string, x string"), ex).collect()}
    assert got == plain
