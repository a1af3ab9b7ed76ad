"""P9: reading level of each document from a linear pairwise ranker calibrated by isotonic regression.

Texts are cut into clauses; each clause has syntax features (lengths of clause, words and sentence, long
words, signs, clauses a sentence) and a vocabulary feature. A linear ranker learns from all pairs of graded passages of one language and different
bands which of the two is harder; isotonic regression turns its scores into levels.

Graded passages hold few words, the corpus many. So the first ranker, on hashed words, places every
document of the corpus; counts of every word per level over all documents then give each word its
evidence for each level, and this evidence becomes the vocabulary feature of the final ranker,
which scores clauses. A document's band is the level most of its sentences have.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlake.runtime import require_columns

BANDS = (1, 2, 3, 4, 5)
#: Hash buckets of words: the size of every model table, whatever the corpus.
BUCKETS = 1 << 17
#: Buckets of the first ranker, which only knows the graded passages.
SMALL = 1 << 15
#: Graded passages used for training, at most; the pairs of these passages are all used.
MAX_EXAMPLES = 1_000

_MARKUP = regex.compile(r"<[^<>\n]{1,80}>|&[a-z]{2,6};|https?://\S+|<\|[^|\n]{1,30}\|>")
_ITEM = regex.compile(r"^\s*([一二三四五六七八九十]{1,3}、|[(（][一二三四五六七八九十\d]{1,3}[)）]|\d{1,2}[.、)]\s)", regex.M)
#: Ends a line that is no sentence.
_FRAGMENT = "\x01"
#: A line of at most so many characters (with Han, without) that ends no sentence is a fragment: a
#: title, a number, a date. Its words count like all others; it has no vote on the band.
FRAGMENT_CHARS = (30, 70)
_CUT = "。！？；，：!?;,.:\n\x00\x01"
_FINAL = "。！？!?.;；"
_CLOSING = "。，、；：！？,.;:!?)）》」”’"
_HAN = regex.compile(r"\p{Han}")
_MULT = np.uint64(0x9E3779B97F4A7C15)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    p = np.uint64(6364136223846793005)
    inverse = np.uint64(pow(int(p), -1, 1 << 64))
    with np.errstate(over="ignore"):
        up, down = np.full(n, p), np.full(n, inverse)
        up[0] = down[0] = 1
        return np.multiply.accumulate(up), np.multiply.accumulate(down)


@dataclass
class Clauses:
    """Clauses of a batch of texts: text index, sizes, scripts, hashed terms and what stands before."""

    doc: np.ndarray
    chars: np.ndarray
    words: np.ndarray
    letters: np.ndarray
    han: np.ndarray
    term: np.ndarray
    of: np.ndarray  # clause of each term
    initial: np.ndarray  # whether a sentence mark, and no comma, stands before the clause
    fragment: np.ndarray  # whether the clause is in a line that is no sentence
    long: np.ndarray  # words of 8 letters and more
    marks: np.ndarray  # digits, brackets, quotes and other signs
    sentence: np.ndarray  # number of the clause's sentence


def _flat_width(text: str) -> int:
    """Width of a text that has a line break after every so many characters, whatever stands there,
    at least twice; else 0."""
    breaks = [i for i, x in enumerate(text) if x == "\n"]
    for w in breaks:
        if 2 * w + 1 >= len(text):
            break
        at = range(w, len(text), w + 1)
        if w >= 20 and all(text[i] == "\n" for i in at) and any(text[i - 1] not in _FINAL for i in at):
            return w
    return 0


def unwrap(text: str) -> str:
    """Text with its hard-wrapped lines joined.

    A line that ends no sentence goes on in the next one when that starts like a continuation (blank,
    small letter, closing mark), when it ends in a blank or comma, or when it has the text's wrap width:
    the next word would have made it longer than the longest line, and so for two lines at least.
    """
    if w := _flat_width(text):
        return "".join(text[i : i + w] for i in range(0, len(text), w + 1))
    lines = text.split("\n")
    longest = max(map(len, lines))
    open_ = [bool(a.strip() and b.strip()) and a.rstrip()[-1] not in _FINAL for a, b in zip(lines, lines[1:])]
    full = [o and len(a) + (1 if _HAN.match(b) else 1 + len(b.split(None, 1)[0])) > longest >= 20 for o, a, b in zip(open_, lines, lines[1:])]
    wrapped = sum(full) > 1
    inside = wrapped and all(len(a) == longest for f, a in zip(full, lines) if f)  # cut within words
    out = [lines[0]]
    for o, f, a, b in zip(open_, full, lines, lines[1:]):
        if not (o and (wrapped and f or a[-1].isspace() or a[-1] in ",，、" or b[0].isspace() or b[0].islower() or b[0] in _CLOSING)):
            out += ["\n", b]
        else:
            bare = inside and f or a[-1].isspace() or b[0].isspace() or b[0] in _CLOSING or _HAN.match(a[-1] + b[0])
            out += [b if bare else " " + b]
    return "".join(out)


def plain(text: str) -> str:
    """Text without markup and list numbers, wrapped lines joined, fragment lines marked at their end."""
    t = _ITEM.sub("", _MARKUP.sub(" ", unwrap(text) if "\n" in text else text)).replace(_FRAGMENT, " ")
    if "\n" not in t:
        return t
    short = lambda x: len(x) <= FRAGMENT_CHARS[0 if _HAN.search(x) else 1]
    return "\n".join(x + _FRAGMENT if x[-1] not in _FINAL and short(x) else x for x in map(str.strip, t.split("\n")) if x)


def clauses(texts: Sequence[str]) -> Clauses:
    """All clauses that have a word, by array operations over the whole batch."""
    joined = "\x00".join(unicodedata.normalize("NFKC", plain(t)).replace("\x00", " ") for t in texts).lower()
    code = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
    if not len(code):
        z = np.zeros(0, np.int64)
        return Clauses(z, z, z, z, z, z, z, z.astype(bool), z.astype(bool), z, z, z)
    cut = np.isin(code, np.array([ord(c) for c in _CUT + "．､｡、"], np.uint32))
    han = (code >= 0x4E00) & (code <= 0x9FFF)
    latin = ((code >= 97) & (code <= 122)) | ((code >= 0xC0) & (code <= 0x24F)) | (code == 0x2019) | (code == 39)
    opens = np.isin(code, np.array([ord(c) for c in _FINAL + "．｡\n\x00\x01"], np.uint32))
    line = np.cumsum((code == 10) | (code == 0))
    no_sentence = np.zeros(int(line[-1]) + 1, bool)
    no_sentence[line[code == 1]] = True
    blank = (code == 32) | (code == 0x3000)
    clause = np.cumsum(cut)
    doc = np.cumsum(code == 0)
    # words: polynomial hash between their ends
    before = np.concatenate([[False], latin[:-1]])
    after = np.concatenate([latin[1:], [False]])
    start, stop = np.flatnonzero(latin & ~before), np.flatnonzero(latin & ~after)
    up, down = _powers(len(code) + 1)
    with np.errstate(over="ignore"):
        total = np.concatenate([[np.uint64(0)], np.cumsum(code.astype(np.uint64) * up[:-1])])
        word = (total[stop + 1] - total[start]) * down[start]
        word = (word ^ (word >> np.uint64(31))) * _MULT
        w_clause = clause[start]
        pair = np.flatnonzero(w_clause[1:] == w_clause[:-1])
        two = (word[pair] * np.uint64(3) + word[pair + 1]) * _MULT
        at = np.flatnonzero(han[:-1] & han[1:])
        gram = (code[at].astype(np.uint64) * np.uint64(0x10001) + code[at + 1]) * _MULT
        hashes = np.concatenate([word, two, gram])
        term = ((hashes ^ (hashes >> np.uint64(29))) * _MULT >> np.uint64(40)).astype(np.int64) % BUCKETS
    of = np.concatenate([w_clause, w_clause[pair], clause[at]])
    n = int(clause[-1]) + 1
    used = np.unique(of)
    index = np.full(n, -1, np.int64)
    index[used] = np.arange(len(used))
    first = np.full(n, len(code), np.int64)
    np.minimum.at(first, clause, np.arange(len(code)))
    count = lambda x, w=None: np.bincount(x, w, n)[used]
    letters = count(clause, latin)
    hans = count(clause, han)
    within = np.minimum(first[used] + 1, len(code) - 1)
    sentence = np.cumsum(opens)[first[used]]
    return Clauses(
        doc[within] if len(used) else used, letters + hans, count(w_clause) + hans, letters, hans, term, index[of], opens[first[used]] | (first[used] == 0),
        no_sentence[line[within]] if len(used) else used.astype(bool), count(w_clause, stop - start >= 7), count(clause, ~(latin | han | cut | blank)), sentence - (sentence[0] if len(used) else 0),
    )


# The ranker ---------------------------------------------------------------------------------------


def syntax(c: Clauses) -> np.ndarray:
    """Per clause: log length in words, mean word length, share of long words, digits and signs a word,
    and of its sentence: log number of clauses, log length in words."""
    words, n = np.maximum(c.words, 1), int(c.sentence[-1]) + 1 if len(c.sentence) else 0
    held, whole = np.bincount(c.sentence, minlength=n)[c.sentence], np.bincount(c.sentence, c.words, n)[c.sentence]
    latin = c.han <= c.letters
    return np.stack([
        np.log(words), np.where(latin, c.letters / words / 5, 0), np.where(latin, c.long / words, 0), np.minimum(c.marks / words, 2),
        np.log(np.maximum(held, 1)), np.log(np.maximum(whole, 1)),
    ], 1)


SYNTAX = 6


def hashed(c: Clauses, n_docs: int) -> np.ndarray:
    """Per text: means of the syntax features and shares of word buckets."""
    x = np.zeros((n_docs, SMALL + SYNTAX))
    np.add.at(x, (c.doc[c.of], c.term % SMALL), 1.0)
    x[:, :SMALL] /= np.maximum(x[:, :SMALL].sum(1, keepdims=True), 1)
    n = np.maximum(np.bincount(c.doc, minlength=n_docs), 1)
    for k, col in enumerate(syntax(c).T):
        x[:, SMALL + k] = np.bincount(c.doc, col, n_docs) / n
    return x


def fit_ranker(x: np.ndarray, band: np.ndarray, group: np.ndarray, ridge: float = 1e-3, steps: int = 300, strength: Sequence[float] | None = None) -> np.ndarray:
    """Weights w with x.w ordered like the bands: logistic loss over all pairs of one group (language)
    and different bands, by accelerated gradient descent. strength below 1 holds a feature's weight
    down (a ridge of 1/strength squared)."""
    i, j = np.nonzero((band[:, None] > band[None, :]) & (group[:, None] == group[None, :]))
    w = np.zeros(x.shape[1])
    if not len(i):
        return w
    scale = np.maximum(x.std(0), 1e-9) / (1.0 if strength is None else np.array(strength))
    z = x / scale
    gap = (band[i] - band[j]).astype(float)
    v, rate = w.copy(), 4.0 * len(i) / max(float((np.bincount(i, minlength=len(x)) + np.bincount(j, minlength=len(x))).max()) * float((z * z).sum(1).max()), 1e-9)
    for t in range(steps):
        s = z @ v
        p = gap / (1 + np.exp(np.clip(s[i] - s[j], -30, 30)))
        back = np.bincount(i, p, len(x)) - np.bincount(j, p, len(x))
        new = v + rate * (z.T @ back / len(i) - ridge * v)
        v, w = new + t / (t + 3) * (new - w), new
    return w / scale


def isotonic(score: np.ndarray, level: np.ndarray, least: float = 1) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators fit: (scores, non-decreasing levels) to interpolate between. Blocks of
    fewer than least cases join the nearer neighbour, so that no single case sets a threshold."""
    at = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # level sum, weight, score sum
    for s, y in zip(score[at], level[at].astype(float)):
        blocks.append([y, 1.0, s])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            y2, n2, s2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + y2, blocks[-1][1] + n2, blocks[-1][2] + s2]
    while len(blocks) > 1 and min(b[1] for b in blocks) < least:
        k = min(range(len(blocks)), key=lambda i: (blocks[i][1], i))
        mean = lambda i: blocks[i][2] / blocks[i][1]
        to = k + 1 if k == 0 or (k + 1 < len(blocks) and mean(k + 1) - mean(k) < mean(k) - mean(k - 1)) else k - 1
        blocks[to] = [a + b for a, b in zip(blocks[to], blocks[k])]
        del blocks[k]
    return np.array([b[2] / b[1] for b in blocks]), np.array([b[0] / b[1] for b in blocks])


def language_of(c: Clauses, n_docs: int) -> np.ndarray:
    """1 for texts mostly in Han characters, else 0."""
    return (np.bincount(c.doc, c.han, n_docs) > np.bincount(c.doc, c.letters, n_docs)).astype(int)


# Models -------------------------------------------------------------------------------------------


@dataclass
class FirstRanker:
    """Word weights from the graded passages, with its calibration per language (0 Latin, 1 Han)."""

    weight: np.ndarray
    known: np.ndarray
    levels: list[tuple[np.ndarray, np.ndarray]]

    @classmethod
    def fit(cls, texts: Sequence[str], band: np.ndarray) -> FirstRanker:
        c, n = clauses(texts), len(texts)
        lang = language_of(c, n)
        w = fit_ranker(hashed(c, n), band, lang)[:SMALL]
        known = np.zeros(SMALL, bool)
        known[c.term % SMALL] = True
        model = cls(w, known, [])
        score, _ = model.scores(c, n)
        model.levels = [isotonic(score[lang == g], band[lang == g]) if (lang == g).any() else (np.zeros(1), np.array([3.0])) for g in (0, 1)]
        return model

    def scores(self, c: Clauses, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Mean weight of the known words of each text, and their number."""
        t, d = c.term % SMALL, c.doc[c.of]
        k = self.known[t]
        count = np.bincount(d[k], minlength=n)
        return np.bincount(d[k], self.weight[t[k]], n) / np.maximum(count, 1), count

    def prior(self, c: Clauses, n: int) -> np.ndarray:
        """Soft level of each text (n x 5); even where no word is known."""
        score, count = self.scores(c, n)
        lang = language_of(c, n)
        level = np.where(lang == 1, np.interp(score, *self.levels[1]), np.interp(score, *self.levels[0]))
        p = np.exp(-1.5 * (level[:, None] - np.array(BANDS)) ** 2)
        p[count == 0] = 1
        return p / p.sum(1, keepdims=True)


def word_evidence(counts: np.ndarray, eps: float = 0.5) -> np.ndarray:
    """(2, BUCKETS, k) log evidence of every word bucket for each of k classes, from counts of that shape."""
    out = np.zeros(counts.shape, np.float32)
    for g in range(len(counts)):
        total = counts[g].sum(0) + 1
        rate = (counts[g] + eps) / (total / total.mean())
        out[g] = np.log(rate / rate.mean(1, keepdims=True))
    return out


def clause_levels(c: Clauses, n: int, first: FirstRanker, evidence: np.ndarray, rounds: int = 2) -> np.ndarray:
    """Probability of each level per clause: word evidence, with the rest of its text as the prior."""
    lang = language_of(c, n)[c.doc]
    words = np.zeros((len(c.doc), 5))
    found = evidence[lang[c.of], c.term]
    for b in range(5):
        words[:, b] = 0.5 * np.bincount(c.of, found[:, b], len(c.doc))
    prior = first.prior(c, n)
    told = np.where(c.fragment, 0.02, 1.0) * c.chars  # a text of fragments only is told by them
    for _ in range(rounds):
        s = words + np.log(0.9 * prior[c.doc] + 0.02)
        p = np.exp(s - s.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        prior = np.stack([np.bincount(c.doc, p[:, b] * told, n) for b in range(5)], 1)
        prior /= np.maximum(prior.sum(1, keepdims=True), 1e-9)
    return p


def sentence_weight(c: Clauses, n: int, opening: np.ndarray) -> np.ndarray:
    """1 for a clause that opens a sentence, near 0 for one that continues it or is in a fragment.

    Told from its words and not from the mark before it: in some texts every comma has become a full
    stop, in others whole sentences are strung together by commas. opening is word evidence for
    (opens, continues) from all documents, most of which are punctuated as usual.
    """
    e = opening[language_of(c, n)[c.doc][c.of], c.term]
    odds = 0.5 * np.bincount(c.of, e[:, 0] - e[:, 1], len(c.doc))
    return np.where((odds > 0) & ~c.fragment, 1.0, 0.02)


#: Weight of a syntax feature in standard deviations, against 1 for the vocabulary.
SYNTAX_STRENGTH = 0.15


@dataclass
class FinalRanker:
    """Linear ranker over vocabulary evidence and syntax, with its calibration per language."""

    weight: np.ndarray
    levels: list[tuple[np.ndarray, np.ndarray]]

    @staticmethod
    def features(c: Clauses, p: np.ndarray) -> np.ndarray:
        return np.column_stack([p @ np.array(BANDS, float), syntax(c)])

    @classmethod
    def fit(cls, texts: Sequence[str], band: np.ndarray, first: FirstRanker, evidence: np.ndarray) -> FinalRanker:
        c, n = clauses(texts), len(texts)
        lang = language_of(c, n)
        f = cls.features(c, clause_levels(c, n, first, evidence))
        held = np.maximum(np.bincount(c.doc, minlength=n), 1)
        x = np.stack([np.bincount(c.doc, f[:, k], n) / held for k in range(f.shape[1])], 1)
        # a clause's syntax says less of it than a passage's mean syntax of the passage
        w = fit_ranker(x, band, lang, strength=(1, *[SYNTAX_STRENGTH] * SYNTAX))
        # clauses are what is scored, so clauses of the passages calibrate the scores
        score, of = f @ w, lang[c.doc]
        return cls(w, [isotonic(score[of == g], band[c.doc][of == g], 0.02 * (of == g).sum()) if (of == g).any() else (np.zeros(1), np.array([3.0])) for g in (0, 1)])

    def level(self, c: Clauses, p: np.ndarray, lang: np.ndarray) -> np.ndarray:
        s = self.features(c, p) @ self.weight
        return np.where(lang == 1, np.interp(s, *self.levels[1]), np.interp(s, *self.levels[0]))


def _slices(texts: list[str], chars: int = 1_000_000) -> Iterator[list[int]]:
    """Row numbers in runs of about a million characters; a longer text is a run of its own."""
    at: list[int] = []
    size = 0
    for i, t in enumerate(texts):
        if at and size + len(t) > chars:
            yield at
            at, size = [], 0
        at.append(i)
        size += len(t)
    if at:
        yield at


# The operator -------------------------------------------------------------------------------------


def _graded(examples: DataFrame, text: str, band: str) -> tuple[list[str], np.ndarray]:
    rows = examples.select(text, band).filter(f"{text} is not null and {band} between 1 and 5").orderBy(F.xxhash64(text), text, band).limit(MAX_EXAMPLES).collect()
    if not rows:
        raise ValueError("no graded passages")
    return [r[0] for r in rows], np.array([r[1] for r in rows])


def corpus_evidence(texts: DataFrame, first: FirstRanker) -> tuple[np.ndarray, np.ndarray]:
    """Evidence of every word for the levels, and for opening or continuing a sentence, from counts
    over all texts (column _t): tables of fixed size."""
    shared = texts.sparkSession.sparkContext.broadcast(first)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, counts = shared.value, np.zeros((2, BUCKETS, 7))
        for b in batches:
            rows = b.column("_t").to_pylist()
            for at in _slices(rows):
                c = clauses([rows[i] for i in at])
                if not len(c.term):
                    continue
                p, lang = model.prior(c, len(at)), language_of(c, len(at))[c.doc]
                d = c.doc[c.of]
                cell = lang[c.of] * BUCKETS + c.term
                for k in range(5):
                    counts[:, :, k] += np.bincount(cell, p[d, k], 2 * BUCKETS).reshape(2, BUCKETS)
                opens = c.initial[c.of]
                counts[:, :, 5] += np.bincount(cell[opens], minlength=2 * BUCKETS).reshape(2, BUCKETS)
                counts[:, :, 6] += np.bincount(cell[~opens], minlength=2 * BUCKETS).reshape(2, BUCKETS)
        flat = counts.reshape(-1, 7)
        used = np.flatnonzero(flat.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), *[pa.array(flat[used, k].astype(np.float64)) for k in range(7)]], names=["w", *[f"c{k}" for k in range(7)]])

    parts = texts.mapInArrow(run, "w long, " + ", ".join(f"c{k} double" for k in range(7)))
    t = parts.groupBy("w").agg(*[F.sum(f"c{k}").alias(f"c{k}") for k in range(7)]).toArrow()  # 2 x BUCKETS rows at most
    counts = np.zeros((2 * BUCKETS, 7))
    counts[t.column("w").to_numpy()] = np.stack([t.column(f"c{k}").to_numpy() for k in range(7)], 1)
    counts = counts.reshape(2, BUCKETS, 7)
    return word_evidence(counts[:, :, :5]), word_evidence(counts[:, :, 5:])


def reading_bands(docs: DataFrame, examples: DataFrame, key: str = "doc_id", text: str = "text", example_text: str = "text", example_band: str = "reading_band", default: int = 3) -> DataFrame:
    """(key, reading_band, level, n_clauses) of every row whose text is not null, empty or blank.

    reading_band is the band of most sentences (a tie goes to the easier one), each told by the clause
    that opens it; level is the mean level of all clauses.
    A text without any word has the default band, no level and 0 clauses. Repeated rows are kept.
    examples: graded passages; at most MAX_EXAMPLES, chosen by the hash of their text, are used.
    """
    require_columns(docs, (key, text), "documents")
    require_columns(examples, (example_text, example_band), "graded passages")
    passages, band = _graded(examples, example_text, example_band)
    first = FirstRanker.fit(passages, band)
    used = docs.select(F.col(key).alias("_k"), F.col(text).alias("_t")).filter(F.col("_t").rlike(r"(?U)\S"))
    evidence, opening = corpus_evidence(used.select("_t"), first)
    final = FinalRanker.fit(passages, band, first, evidence)
    shared = docs.sparkSession.sparkContext.broadcast((first, evidence, opening, final))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, evidence, opening, final = shared.value
        for b in batches:
            rows = b.column("_t").to_pylist()
            found, level, count = np.full(len(rows), default), np.full(len(rows), np.nan), np.zeros(len(rows), np.int64)
            for at in _slices(rows):
                n = len(at)
                c = clauses([rows[i] for i in at])
                if not len(c.doc):
                    continue
                y = final.level(c, clause_levels(c, n, first, evidence), language_of(c, n)[c.doc])
                votes = np.zeros((n, 5))
                np.add.at(votes, (c.doc, np.clip(np.rint(y), 1, 5).astype(int) - 1), sentence_weight(c, n, opening))
                held = np.bincount(c.doc, minlength=n)
                found[at] = np.where(held > 0, votes.argmax(1) + 1, default)
                count[at] = held
                level[at] = np.where(held > 0, np.bincount(c.doc, y, n) / np.maximum(held, 1), np.nan)
            yield pa.RecordBatch.from_arrays([b.column("_k"), pa.array(found.astype(np.int32)), pa.array(level, from_pandas=True), pa.array(count)], names=["_k", "reading_band", "level", "n_clauses"])

    kind = used.schema["_k"].dataType.simpleString()
    return used.mapInArrow(run, f"_k {kind}, reading_band int, level double, n_clauses long").withColumnRenamed("_k", key)
