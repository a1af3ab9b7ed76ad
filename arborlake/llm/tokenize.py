"""P7: encoding of whole texts with a public byte-level BPE vocabulary through sentencepiece.

The vocabulary's ranks become a sentencepiece BPE model, serialised here field by field: piece i is
token i with its bytes mapped to printable characters and the score -i, so the model merges in rank
order; normalisation is the identity. A text is cut into pre-tokens, which are joined by a character
no piece contains: merges cannot cross it, so one call encodes a batch of whole texts. The model
travels to the executors as bytes (about 1 MB, the vocabulary's size and not the corpus').
"""

from __future__ import annotations

import base64
import os
import struct
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborlake.runtime import require_columns

TOKENIZER_DIR = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")

# Fixed value: the pattern that cuts texts before merges of the rank vocabulary.
PRETOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Texts encoded in one go, which bounds a worker's memory.
ROWS_AT_ONCE = 1_000

#: Stands between pre-tokens; byte 0xFF never occurs in UTF-8.
_SEP = 0xFF
_SEP_CHAR = "\ue000"


def byte_characters() -> dict[int, str]:
    """Byte -> printable character: printable Latin-1 stays, the rest takes 256, 257, ... in order."""
    keep = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in keep]
    return {b: chr(b) if b in keep else chr(256 + rest.index(b)) for b in range(256)}


def read_ranks(path: str) -> list[bytes]:
    """Tokens in rank order of a file of base64 token and rank per line."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    ranks = {int(r): base64.b64decode(t) for t, r in pairs}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks have gaps")
    return [ranks[i] for i in range(len(ranks))]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes(out + bytearray([n]))


def _field(number: int, value: int | float | bytes) -> bytes:
    """One field of the wire format: varint, 32-bit float or length-delimited."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def serialise_model(tokens: list[bytes]) -> bytes:
    """A sentencepiece BPE model of the tokens; the id after the last token is the unknown piece."""
    chars = byte_characters()
    pieces = [_field(1, _field(1, "".join(chars[b] for b in t).encode()) + _field(2, float(-i))) for i, t in enumerate(tokens)]
    pieces.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2)))
    none = (1 << 64) - 1  # -1: no such piece
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(40, len(tokens)) + _field(41, none) + _field(42, none) + _field(43, none)
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normalizer)


class BytePairEncoder:
    """Encodes and decodes texts with a serialised model; made once per Python worker."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.unknown = self.model.unk_id()
        chars = byte_characters()
        self.table = {b: c for b, c in chars.items()} | {_SEP: _SEP_CHAR}
        self.back = {ord(c): chr(b) for b, c in chars.items()}
        self.cut = regex.compile(PRETOKEN)
        self.known: dict[str, array] = {}

    def encode_flat(self, texts: Iterable[str | None]) -> tuple[array, array]:
        """(offsets, ids of all texts in one run); a null or empty text has no ids. Whole texts,
        whatever their length.

        Pre-tokens recur far more often than texts, so each is encoded once per worker and copied
        from then on; the memory of pre-tokens starts anew at 200,000 of them.
        """
        cut = [self.cut.findall(t) if t else [] for t in texts]
        known = self.known
        if len(known) > 200_000:
            known.clear()
        fresh = list({p for ps in cut for p in ps if p not in known})
        for at in range(0, len(fresh), 4096):
            some = fresh[at : at + 4096]
            mapped = b"\xff".join(p.encode() for p in some).decode("latin-1").translate(self.table)
            ids, start, k = self.model.encode(mapped, out_type=int), 0, 0
            for i, x in enumerate(ids + [self.unknown]):
                if x == self.unknown:
                    known[some[k]] = array("i", ids[start:i])
                    start, k = i + 1, k + 1
        flat, offsets = array("i"), array("i", [0])
        for ps in cut:
            for p in ps:
                flat += known[p]
            offsets.append(len(flat))
        return offsets, flat

    def encode_batch(self, texts: Iterable[str | None]) -> list[list[int]]:
        """Ids per text."""
        offsets, flat = self.encode_flat(texts)
        return [flat[a:b].tolist() for a, b in zip(offsets, offsets[1:])]

    def decode(self, ids: Iterable[int], errors: str = "strict") -> str:
        """Text of the ids; errors as in bytes.decode, for ids that cut a character in two."""
        pieces = "".join(self.model.id_to_piece(int(i)) for i in ids)
        return pieces.translate(self.back).encode("latin-1").decode("utf-8", errors)


def _model(name: str, folder: str | None) -> bytes:
    return serialise_model(read_ranks(f"{folder or TOKENIZER_DIR}/{name}.tiktoken"))


def encode_texts(df: DataFrame, key: str, text: str = "text", tokenizer: str = "byte_bpe_50k", folder: str | None = None, ids: bool = True) -> DataFrame:
    """(key, ids, n_tokens) of every row: ids of the whole text without special tokens.

    Null and empty texts have an empty list and 0 tokens. Rows are kept as they are, repeated keys
    included; other columns are dropped. ids=False leaves the lists out.
    """
    require_columns(df, (key, text), "texts")
    model = df.sparkSession.sparkContext.broadcast(_model(tokenizer, folder))
    keyed = df.select(F.col(key).alias("_k"), F.col(text).alias("_t"))
    kind = keyed.schema["_k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = BytePairEncoder(model.value)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                offsets, flat = (np.frombuffer(x, np.int32) for x in coder.encode_flat(part.column(1).to_pylist()))
                n = pa.array(np.diff(offsets).astype(np.int64))
                if ids:
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), n], names=["_k", "ids", "n_tokens"])
                else:
                    yield pa.RecordBatch.from_arrays([part.column(0), n], names=["_k", "n_tokens"])

    return keyed.mapInArrow(run, f"_k {kind}, " + ("ids array<int>, " if ids else "") + "n_tokens long").withColumnRenamed("_k", key)


def decode_ids(df: DataFrame, key: str, ids: str = "ids", tokenizer: str = "byte_bpe_50k", folder: str | None = None, errors: str = "replace") -> DataFrame:
    """(key, text): the inverse of encode_texts; null ids give a null text. Ids that cut a character in
    two give a replacement character (errors="strict" raises, "ignore" leaves it out)."""
    model = df.sparkSession.sparkContext.broadcast(_model(tokenizer, folder))
    keyed = df.select(F.col(key).alias("_k"), F.col(ids).alias("_i"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = BytePairEncoder(model.value)
        for batch in batches:
            texts = [None if r is None else coder.decode(r, errors) for r in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["_k", "text"])

    return keyed.mapInArrow(run, f"_k {keyed.schema['_k'].dataType.simpleString()}, text string").withColumnRenamed("_k", key)
