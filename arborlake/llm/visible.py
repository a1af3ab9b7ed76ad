"""P3: text that looks the same brought to one form, so that equal strings mean equal looks.

comparison_form is the compatibility normalisation in composed form with full case folding, blanks of
every kind as a space, default-ignorable characters and controls removed, and look-alike letters of
other scripts as Latin ones. It also unites what a reader tells apart (case, raised and circled
characters), so beside it visible_form keeps these apart: only the compatibility classes that differ
in encoding (full and half width, no-break, radicals and compatibility ideographs, ligatures) are
resolved and case stays. Equal visible forms have equal comparison forms.

Look-alikes come from the public table of confusable characters that ICU, which Spark ships, carries.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Mapping, Sequence
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arborlake.runtime import require_columns

# Characters of one shape that the confusables table leaves out or gives as marks.
EXTRA = {"Ԛ": "Q", "⻆": "角", "⻦": "鸟", "‐": "-", "−": "-", "µ": "μ"}

_SEP = "\x00"
_IGNORED = regex.compile(r"[\p{Default_Ignorable_Code_Point}\p{Cc}--[\x00\t\n\v\f\r\u0085]]", regex.V1)
_BLANK = regex.compile(r"[\s⠀]")

#: Compatibility tags whose characters look like their plain form.
_SAME_LOOK = ("<wide>", "<narrow>", "<noBreak>")


def _compat_same_look(cp: int) -> bool:
    """<compat> blocks that differ in encoding only: radicals, ligatures, Roman numerals, digraphs."""
    return 0x2E80 <= cp <= 0x2FD5 or 0xFB00 <= cp <= 0xFB06 or 0x2160 <= cp <= 0x217F or 0x0132 <= cp <= 0x0133 or 0x01C4 <= cp <= 0x01CC


@lru_cache(None)
def _letters() -> list[str]:
    """Letters and radicals without a decomposition: what may be confused with another character."""
    chars = map(chr, range(0x80, 0x30000))
    return [c for c in chars if (unicodedata.category(c) in ("Lu", "Ll", "Lo") or 0x2E80 <= ord(c) <= 0x2FDF) and not unicodedata.decomposition(c)]


@lru_cache(None)
def lookalikes(spark: SparkSession) -> dict[str, str]:
    """Letter -> the letter it is drawn like, from ICU's confusables table, on the driver.

    A letter of another script takes the Latin letter with the same skeleton and the same case; a
    radical or a Katakana letter takes the ideograph that is its skeleton. Characters whose skeleton
    is several characters, a digit or a mark keep their own look.
    """
    checker = spark.sparkContext._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    skeletons = lambda chars: checker.getSkeleton(2, _SEP.join(chars)).split(_SEP)
    latin = [chr(c) for c in range(65, 123) if chr(c).isalpha()]
    by_skeleton = {(k, unicodedata.category(c)): c for c, k in zip(latin, skeletons(latin))}
    out = {}
    for c, k in zip(_letters(), skeletons(_letters())):
        kind = unicodedata.category(c)
        cased = by_skeleton.get((k, kind)) or (by_skeleton.get((k, "Lu")) if kind == "Lo" else None)
        ideograph = (0x2E80 <= ord(c) <= 0x2FDF or 0x30A0 <= ord(c) <= 0x30FF) and len(k) == 1 and 0x4E00 <= ord(k) <= 0x9FFF
        if cased or ideograph:
            out[c] = cased or k
    return out | EXTRA


def character_map(alike: Mapping[str, str]) -> dict[int, str]:
    """Code point -> replacement after canonical decomposition, by rule plus the look-alikes."""
    out = {}
    for cp in range(0x80, 0x30000):
        parts = unicodedata.decomposition(chr(cp)).split()
        if parts and parts[0][0] == "<" and (parts[0] in _SAME_LOOK or (parts[0] == "<compat>" and _compat_same_look(cp))):
            out[cp] = unicodedata.normalize("NFKD", chr(cp))
    out |= {ord(k): v for k, v in alike.items()}
    return {cp: "".join(alike.get(c, c) for c in text) for cp, text in out.items()}  # a no-break hyphen is a look-alike


def forms(values: Sequence[str], mapping: Mapping[int, str]) -> tuple[list[str], list[str]]:
    """(visible forms, comparison forms) of values, all at once as one string with separators.

    Idempotent; the number and place of visible blanks never change in visible forms. Values of any
    length are taken whole; an empty one has empty forms.
    """
    if not len(values):
        return [], []
    text = _SEP.join(v.replace(_SEP, "") if _SEP in v else v for v in values)
    text = _BLANK.sub(" ", _IGNORED.sub("", text))
    seen = unicodedata.normalize("NFC", unicodedata.normalize("NFD", text).translate(mapping))
    plain = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", seen).casefold())
    return seen.split(_SEP), plain.split(_SEP)


def _column(col: Column | str, spark: SparkSession | None, which: int) -> Column:
    alike = lookalikes(spark or SparkSession.getActiveSession())

    @F.pandas_udf("string")
    def form(s: pd.Series) -> pd.Series:
        codes, values = pd.factorize(s, use_na_sentinel=True)  # every distinct value of a batch once
        done = pd.array([*forms(list(values), _mapping(tuple(alike.items())))[which], None], dtype=pd.ArrowDtype(pa.string()))
        return pd.Series(done.take(codes % len(done)), index=s.index).astype(object).where(codes >= 0, None)

    return form(col)


@lru_cache(2)
def _mapping(alike: tuple[tuple[str, str], ...]) -> dict[int, str]:
    return character_map(dict(alike))


def visible_form(col: Column | str, spark: SparkSession | None = None) -> Column:
    """What a reader sees of a text; null stays null."""
    return _column(col, spark, 0)


def comparison_form(col: Column | str, spark: SparkSession | None = None) -> Column:
    """The one form under which texts are compared; null stays null."""
    return _column(col, spark, 1)


def unify_labels(nodes: DataFrame, columns: tuple[str, ...] = ("label", "human_label"), key: str = "node_id", order: str = "loaded_at") -> DataFrame:
    """One row per non-null key, its newest row's columns with their comparison forms (<column>_form)
    and visible forms (<column>_seen).

    Copies collapse; equal times: the larger values count. Null labels have null forms, empty ones
    empty forms. Other columns are dropped.
    """
    require_columns(nodes, (key, order, *columns), "nodes")
    newest = nodes.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(order, *columns)).alias("_x")).select(key, "_x.*")
    spark = nodes.sparkSession
    return newest.withColumns({f"{c}_form": comparison_form(c, spark) for c in columns} | {f"{c}_seen": visible_form(c, spark) for c in columns})
