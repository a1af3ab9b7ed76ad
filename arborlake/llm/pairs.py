"""P1: defective prompt-response pairs and their defect type.

Every response is unwrapped (code fences, lead-ins, JSON fields) to the prose it gives, then tested
in a fixed order, each test on the whole text: empty, copy, refusal, other_language, truncated.

* Languages: posteriors of a character n-gram naive Bayes model over the prose of prompt and
  response, quoted labels, ids and field names masked; a language the prompt names outweighs the
  prompt's own. A response in a script that no language of the model has is in another language.
* Refusals: naive Bayes over n-grams, from a few sentences that decline and then from the log itself.
* Truncation: prose without a closing mark whose last characters rarely end a sentence in the
  responses (end-of-text n-gram likelihood over all responses); JSON that ends inside a string or an
  open bracket. JSON that merely needs repair is no defect.
"""

from __future__ import annotations

import json
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlake.llm.answer_models import BUCKETS, LANGUAGES, LanguageModel, RefusalModel, grams
from arborlake.runtime import Stage, spread

DEFECTS = ("empty", "copy", "refusal", "other_language", "truncated")

# Names of languages as prompts write them.
NAMES = {
    "zh": r"中文|汉语|漢語|华语|普通话|Chinese|Mandarin", "en": r"英文|英语|英語|English", "ja": r"日文|日语|日本語|Japanese", "ko": r"韩文|韩语|한국어|Korean",
    "fr": r"法文|法语|French|français", "es": r"西班牙文|西班牙语|Spanish|español", "de": r"德文|德语|German|Deutsch", "ru": r"俄文|俄语|Russian|русск\w*",
    "pt": r"葡萄牙文|葡萄牙语|Portuguese|português", "it": r"意大利文|意大利语|Italian|italiano",
}
_FENCE = regex.compile(r"```\s*\w*")
_QUOTED = regex.compile(r"「[^」]*(」|$)|『[^』]*(』|$)|“[^”]*(”|$)|《[^》]*(》|$)|\"[^\"]*(\"|$)")
_CLOSED = regex.compile(r"「[^」]*」|『[^』]*』|“[^”]*”|《[^》]*》|\"[^\"]*\"")
_ID = regex.compile(r"\b[A-Za-z]\d?_\w+\b")
_END = "。．.!！?？」』”\"）)】]》…:：;；"
_STOP = "。．.!！?？"
_SENTENCE = regex.compile(r"[^。！？!?\n]*?[。！？!?]+|[^。！？!?\n]*?\.(?=\s|$)|[^。！？!?\n]+")
_IGNORED = regex.compile(r"[\p{Default_Ignorable_Code_Point}\p{Cc}\p{Cs}]+")
#: Fields of a JSON answer that hold no prose.
_CODES = {"action", "groups", "child_ids", "bridge_label", "id", "ids", "node_id"}
_FIELD = regex.compile(r"\b(json|reason|" + "|".join(sorted(_CODES, key=len, reverse=True)) + r")\b", regex.I)
_ELLIPSIS = regex.compile(r"(\.{3,}|。{3,}|…+)")
_LETTER, _LETTERS, _WORD, _OTHER = regex.compile(r"\p{L}"), regex.compile(r"\p{L}{2}"), regex.compile(r"\w"), regex.compile(r"[\W_]+")
_NEXT = regex.compile(r"[。.!?！？]\s*\S")
_NOTHING = {"", "null", "none", "nan", "na", "nil", "undefined", "empty", "无", "暂无", "空"}


def clean(text: str | None) -> str:
    return _IGNORED.sub(" ", text or "").strip()


def open_end(text: str) -> tuple[bool, int]:
    """(ends inside a string, number of brackets left open) of JSON text."""
    inside, escaped, depth = False, False, 0
    for c in text:
        if inside:
            if escaped:
                escaped = False
            elif c == "\\":
                escaped = True
            elif c == '"':
                inside = False
        elif c == '"':
            inside = True
        elif c in "{[":
            depth += 1
        elif c in "}]":
            depth = max(0, depth - 1)
    return inside, depth


def _strings(value, key: str = "") -> list[str]:
    if isinstance(value, dict):
        return [s for k, v in value.items() if k not in _CODES for s in _strings(v, k)]
    if isinstance(value, list):
        return [s for v in value for s in _strings(v, key)]
    return [value] if isinstance(value, str) else []


def _filled(value) -> bool:
    if isinstance(value, dict):
        return any(_filled(v) for v in value.values())
    if isinstance(value, list):
        return any(_filled(v) for v in value)
    return value is not None and str(value).strip().lower() not in _NOTHING


def unwrap(raw: str | None) -> dict:
    """prose, whether it came from JSON, whether the JSON is cut off, and whether anything is said."""
    t = clean(_FENCE.sub(" ", raw or ""))
    at = t.find("{")
    lead = t[:at] if at >= 0 else ""
    if at < 0 or len(lead) > 60 or _NEXT.search(lead.rstrip(" .。:：!！") or ""):
        bare = _OTHER.sub("", t).lower()
        if t[:1] == '"' and t[-1:] == '"' and len(t) > 1:
            t = t[1:-1].strip()
        return {"prose": t, "json": False, "cut": False, "said": bare not in _NOTHING}
    body = t[at:]
    try:
        value = json.loads(body, strict=False)
        return {"prose": " ".join(s.strip() for s in _strings(value)), "json": True, "cut": False, "said": _filled(value), "answer": isinstance(value, dict) and _filled(value.get("action"))}
    except ValueError:
        inside, depth = open_end(body)
        tail = body.rstrip()[-1:]
        cut = depth > 0 and not (inside and tail == "}")
        prose = [regex.sub(r'\\"', '"', m[1]) for m in regex.finditer(r'"(?:reason|error|explanation|answer|text|message|content)"\s*:\s*"(.*?)(?="\s*[,}\]]|$)', body, regex.S)]
        said = bool(_WORD.search(regex.sub(r'"\w+"\s*:', "", body)))
        return {"prose": " ".join(prose), "json": True, "cut": cut, "said": said or cut, "answer": '"action"' in body}


def mask(text: str) -> str:
    """Prose without quoted labels, ids and field names."""
    return _FIELD.sub(" ", _ID.sub(" ", _QUOTED.sub(" ", text)))


# Languages ----------------------------------------------------------------------------------------

_NAMED = regex.compile("|".join(f"(?P<{k}>{v})" for k, v in NAMES.items()), regex.I)


def named_language(own: str) -> str | None:
    """The language named last in the prompt's own words (mask())."""
    last = None
    for m in _NAMED.finditer(own):
        last = m.lastgroup
    return last


def instruction(own: str) -> str:
    """The last two sentences of the prompt's own words: its instruction."""
    sentences = [s for s in _SENTENCE.findall(own) if _LETTERS.search(s)]
    return " ".join(sentences[-2:]) or own


# Copies -------------------------------------------------------------------------------------------

_LEAD = regex.compile(r"^\W*(您的问题是|你的问题是|问题|原文|您问|你问|题目|You asked|Your question( was| is)?|Question|Prompt|The prompt (was|is))\s*[:：]\s*", regex.I)


def _bare(text: str) -> str:
    return _OTHER.sub("", unicodedata.normalize("NFKC", text)).lower()


def is_copy(prose: str, prompt: str, n: int = 5, of_prose: float = 0.8, of_prompt: float = 0.4) -> bool:
    """Whether the n-grams of the prose are the prompt's to that share and make up that share of it.

    Looking up the prose's n-grams ends as soon as too many are not the prompt's."""
    a, b = _bare(_LEAD.sub("", prose)), _bare(prompt)
    if len(a) < n or len(b) < n:
        return bool(a) and a == b
    total = len(a) - n + 1
    may_miss = (1 - of_prose) * total
    own = b if len(b) < 2_000 else {b[i : i + n] for i in range(len(b) - n + 1)}
    for i in range(total):
        if a[i : i + n] not in own:
            may_miss -= 1
            if may_miss < 0:
                return False
    ga = {a[i : i + n] for i in range(total)}
    return sum(b[i : i + n] in ga for i in range(len(b) - n + 1)) >= of_prompt * (len(b) - n + 1)


# Truncation ---------------------------------------------------------------------------------------

_N = (6, 5, 4, 3, 2)
#: A text ends where sentences do with at least this likelihood, else it breaks off.
END_LIKELIHOOD = 0.5
#: Weight, in occurrences, of the next shorter n-gram's likelihood in the interpolation.
SHORTER = 3.0


def mask_quotes(text: str) -> str:
    """Text with every closed label as one character; a label left open stays, and ends no sentence."""
    return _ELLIPSIS.sub("…", _CLOSED.sub("\N{REPLACEMENT CHARACTER}", text))


def last_grams(prose: str) -> list[str] | None:
    """The n-grams a text ends with, longest first; None when a mark closes it or it has no letter."""
    t = mask_quotes(prose).rstrip()
    if not _LETTER.search(t) or t[-1] in _STOP or t[-1] in ":：;；":
        return None
    return [t[-n:] for n in _N if len(t) >= n]


def ending_counts(sentences: Counter) -> tuple[Counter, Counter]:
    """(occurrences, occurrences before a closing mark) of the n-grams of closed sentences."""
    n: Counter = Counter()
    e: Counter = Counter()
    for s, k in sentences.items():
        t = s.rstrip()
        if t[-1:] not in _STOP:
            continue
        t = t.rstrip(_STOP)
        for size in _N:
            for i in range(len(t) - size + 1):
                n[t[i : i + size]] += k
            if len(t) >= size:
                e[t[-size:]] += k
    return n, e


def end_likelihood(parsed: DataFrame, counts: DataFrame) -> DataFrame:
    """(_k, ends) of rows with last n-grams (tail): the likelihood that a sentence ends there.

    counts: g, n, e over the whole log. The likelihood of an n-gram is e/n, interpolated with that of
    the next shorter one; a text whose last n-grams are unknown has 0."""
    asked = parsed.filter("tail is not null").select("_k", F.explode("tail").alias("g"))
    known = asked.join(counts, "g").groupBy("_k").agg(F.array_sort(F.collect_list(F.struct(F.length("g").alias("size"), "n", "e"))).alias("x"))
    ends = F.aggregate("x", F.lit(0.0), lambda p, x: (x["e"] + SHORTER * p) / (x["n"] + SHORTER))
    return parsed.filter("tail is not null").select("_k").join(known, "_k", "left").select("_k", F.coalesce(ends, F.lit(0.0)).alias("ends"))


# The operator -------------------------------------------------------------------------------------

_PARTS = "kind int, g string, i long, n long, e long"


def _rows(kind: int, g: list, i, n, e=None) -> pa.RecordBatch:
    size = len(n)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(size, kind, np.int32)), pa.array(g, pa.string()) if g else pa.nulls(size, pa.string()), pa.array(i, pa.int64()) if i is not None else pa.nulls(size, pa.int64()), pa.array(n, pa.int64()), pa.array(e, pa.int64()) if e is not None else pa.nulls(size, pa.int64())],
        names=["kind", "g", "i", "n", "e"])


def _buckets(kind: int, counts: np.ndarray) -> pa.RecordBatch:
    used = np.flatnonzero(counts.ravel())
    return _rows(kind, [], used, counts.ravel()[used].astype(np.int64))


def sentences_of(prose: str) -> list[str]:
    return [t for s in _SENTENCE.findall(mask_quotes(prose)) if (t := s.strip())]


class _Scores:
    """Scores of sentences by a function over many of them; sentences recur, so they are kept a while."""

    def __init__(self, score):
        self.score, self.known = score, {}

    def of(self, texts: list[str]) -> list:
        if len(self.known) > 100_000:
            self.known.clear()
        fresh = [t for t in dict.fromkeys(texts) if t not in self.known]
        for at in range(0, len(fresh), 2_000):
            some = fresh[at : at + 2_000]
            self.known.update(zip(some, self.score(some)))
        return [self.known[t] for t in texts]


def _count_log(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the log: kind 0 ending n-grams, 1 n-grams by language, 2 n-grams of all responses."""
    model, seen = LanguageModel(), Counter()
    by_language, everything = np.zeros((len(LANGUAGES), BUCKETS)), np.zeros(BUCKETS)

    def flush() -> Iterator[pa.RecordBatch]:
        n, e = ending_counts(seen)
        keys = list(n)
        yield _rows(0, keys, None, [n[g] for g in keys], [e[g] for g in keys])
        texts, times = list(seen), np.array(list(seen.values()), float)
        for at in range(0, len(texts), 2_000):
            some, k = texts[at : at + 2_000], times[at : at + 2_000]
            b, o = grams(some, RefusalModel.SIZES)
            everything[:] += np.bincount(b, k[o], BUCKETS)
            own = [mask(t) for t in some]
            p = model.posterior(model.scores(own))
            sure = (p[:, :-1].max(1) > 0.999) & (np.array([len(_LETTER.findall(t)) for t in own]) >= 6)
            b, o = grams(own, LanguageModel.SIZES, True)
            keep = sure[o]
            np.add.at(by_language, (p.argmax(1)[o[keep]], b[keep]), k[o[keep]])
        seen.clear()

    for batch in batches:
        for text in batch.column("prose").to_pylist():
            if text:
                seen.update(sentences_of(text))
        if len(seen) > 100_000:
            yield from flush()
    yield from flush()
    yield _buckets(1, by_language)
    yield _buckets(2, everything)


def _count_refusals(model: RefusalModel):
    """Counts of n-grams of the responses a model takes for refusals (kind 3) and of the others (4)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores, counts = _Scores(model.scores), {True: Counter(), False: Counter()}
        sums = {True: np.zeros(BUCKETS), False: np.zeros(BUCKETS)}

        def add() -> None:
            for no, seen in counts.items():
                texts, times = list(seen), np.array(list(seen.values()), float)
                for at in range(0, len(texts), 2_000):
                    b, o = grams(texts[at : at + 2_000], RefusalModel.SIZES)
                    sums[no] += np.bincount(b, times[at : at + 2_000][o], BUCKETS)
                seen.clear()

        for batch in batches:
            each = [sentences_of(t) if t else [] for t in batch.column("prose").to_pylist()]
            flat = iter(scores.of([s for ss in each for s in ss]))
            for ss in each:
                odds = [next(flat) for _ in ss]
                counts[bool(ss) and sum(odds) > model.TEACHES].update(ss)
            if sum(map(len, counts.values())) > 100_000:
                add()
        add()
        yield _buckets(3, sums[True])
        yield _buckets(4, sums[False])

    return run


def _table(parts: DataFrame, kind: int, size: int) -> np.ndarray:
    """Summed buckets of a kind: a fixed number of rows."""
    t = parts.filter(F.col("kind") == kind).groupBy("i").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size)
    out[t.column("i").to_numpy()] = t.column("n").to_numpy()
    return out


def _judge(languages: LanguageModel, refusals: RefusalModel):
    """Arrow function of (_k, prompt, prose, said): the defect, truncation left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tongue, odds = _Scores(languages.scores), _Scores(refusals.scores)
        at = {k: i for i, k in enumerate(LANGUAGES)}
        for b in batches:
            prompts = [clean(p) for p in b.column("prompt").to_pylist()]
            proses, said = b.column("prose").to_pylist(), b.column("said").to_pylist()
            each = [sentences_of(p) for p in proses]
            declines = iter(odds.of([s for ss in each for s in ss]))
            no = [bool(ss) and sum(next(declines) for _ in ss) > refusals.DECLINES for ss in each]
            own = [mask(p) for p in proses]
            parts = [[t for s in _SENTENCE.findall(o) if (t := s.strip())] for o in own]
            voices = iter(tongue.of([s for ss in parts for s in ss]))
            heard = [sum((next(voices) for _ in ss), np.zeros(len(LANGUAGES) + 1)) for ss in parts]
            asked = [mask(p) for p in prompts]
            named = [named_language(p) for p in asked]
            spoken = tongue.of([instruction(p) for p in asked])
            found: list[str | None] = []
            for i, (prompt, prose) in enumerate(zip(prompts, proses)):
                defect = None
                if not said[i]:
                    defect = "empty"
                elif prompt and prose and is_copy(prose, prompt):
                    defect = "copy"
                elif no[i]:
                    defect = "refusal"
                elif prompt and len(_LETTER.findall(own[i])) >= 6:
                    want = at[named[i]] if named[i] else int(np.argmax(spoken[i]))
                    p = languages.posterior(heard[i])
                    if want < len(LANGUAGES) and int(p.argmax()) != want and p[want] < 0.01:
                        defect = "other_language"
                found.append(defect)
            yield pa.RecordBatch.from_arrays([b.column("_k"), pa.array(found, pa.string())], names=["_k", "defect"])

    return run


def flag_pairs(pairs: DataFrame, key: str, prompt: str, raw: str, order: str) -> DataFrame:
    """(key, defect, evidence) of every defective pair, one row per key.

    prompt, raw and order are expressions; the newest row of a key counts (ties: the larger texts),
    so copies count once. Null or blank responses are empty; a response to a null or blank prompt has
    no language and no copy test. Rows without a key drop out. evidence tells what made it truncated:
    json (syntax) or likelihood; it is null for the other defects. Every count is over the whole log.
    """
    stage = Stage(pairs.sparkSession, "pairs")
    newest = (
        pairs.filter(F.col(key).isNotNull()).select(F.col(key).alias("_k"), F.struct(F.expr(prompt).alias("prompt"), F.expr(raw).alias("raw")).alias("x"), F.expr(order).alias("at"))
        .groupBy("_k").agg(F.max_by("x", F.struct("at", "x")).alias("x")).select("_k", "x.prompt", "x.raw")
    )
    kind = newest.schema["_k"].dataType.simpleString()

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            u = [unwrap(t) for t in b.column("raw").to_pylist()]
            tails = [None if x["cut"] or not x["said"] else last_grams(x["prose"]) for x in u]
            yield pa.RecordBatch.from_arrays(
                [b.column("_k"), b.column("prompt"), pa.array([x["prose"] for x in u], pa.string()), pa.array([x["said"] for x in u]), pa.array([x["cut"] for x in u]), pa.array(tails, pa.list_(pa.string()))],
                names=["_k", "prompt", "prose", "said", "cut", "tail"])

    # few bytes but much work per row
    parsed = stage.save(spread(newest, "_k").mapInArrow(parse, f"_k {kind}, prompt string, prose string, said boolean, cut boolean, tail array<string>"))
    parts = stage.save(spread(parsed.select("prose")).mapInArrow(_count_log, _PARTS))
    languages = LanguageModel(_table(parts, 1, len(LANGUAGES) * BUCKETS).reshape(-1, BUCKETS))
    first = RefusalModel(_table(parts, 2, BUCKETS))
    again = stage.save(spread(parsed.select("prose")).mapInArrow(_count_refusals(first), _PARTS))
    refusals = RefusalModel(_table(again, 4, BUCKETS), _table(again, 3, BUCKETS))
    judged = spread(parsed, "_k").mapInArrow(_judge(languages, refusals), f"_k {kind}, defect string")
    counts = parts.filter("kind = 0").groupBy("g").agg(F.sum("n").alias("n"), F.sum("e").alias("e"))
    ends = end_likelihood(parsed, counts).filter(F.col("ends") < END_LIKELIHOOD).select("_k", F.lit("likelihood").alias("evidence"))
    cut = parsed.filter("cut").select("_k", F.lit("json").alias("evidence"))
    off = ends.unionByName(cut).withColumnRenamed("_k", "_c")
    both = judged.join(off, F.col("_k") == F.col("_c"), "left").filter("defect is not null or evidence is not null")
    return both.select(F.col("_k").alias(key), F.coalesce("defect", F.lit("truncated")).alias("defect"), F.when(F.col("defect").isNull(), F.col("evidence")).alias("evidence"))
