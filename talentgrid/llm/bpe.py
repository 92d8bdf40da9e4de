"""Byte-level BPE through a sentencepiece model that is written straight from a rank file.

Each rank becomes a piece of byte letters with score minus rank, so the library merges in rank order; normalisation is
the identity. Pre-tokens are encoded one by one and decoded by the inverse of the byte letters.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from talentgrid.llm.pieces import Known, units
from talentgrid.llm.tokens import byte_letters

SLICE_ROWS = 256


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file, by rank."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    tokens = {int(rank): base64.b64decode(token) for token, rank in pairs}
    if sorted(tokens) != list(range(len(tokens))):
        raise ValueError("ranks must run from 0 without gaps")
    return [tokens[i] for i in range(len(tokens))]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | int | float) -> bytes:
    """One field of a serialised message: a number, a 32-bit float or bytes."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def model_bytes(tokens: list[bytes]) -> bytes:
    """A sentencepiece BPE model whose id of a token is its rank; the unknown piece it must have comes last and is unused."""
    letter = {b: c for c, b in byte_letters().items()}
    piece = lambda text, score, kind: _field(1, _field(1, text.encode()) + _field(2, score) + _field(3, kind))
    normal, unknown, bpe, none = 1, 2, 2, (1 << 64) - 1  # sentencepiece's numbers for kinds of pieces and models; -1
    pieces = [piece("".join(letter[b] for b in t), -float(i), normal) for i, t in enumerate(tokens)] + [piece("<unk>", 0.0, unknown)]
    trainer = _field(3, bpe) + _field(4, len(pieces)) + _field(40, len(tokens)) + _field(41, none) + _field(42, none) + _field(43, none)
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normaliser)


class Coder:
    """Encodes texts to ranks and decodes ranks to bytes."""

    def __init__(self, path: str, pattern: str):
        self.tokens = read_ranks(path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(self.tokens))
        self.find = regex.compile(pattern).findall
        self.letters = {b: c for c, b in byte_letters().items()}
        self.known = Known(self._of_units)

    def _of_units(self, new: list[str]) -> list[bytes]:
        split = [self.find(u) for u in new]
        pieces = list({p for parts in split for p in parts})
        mapped = [p.encode().decode("latin-1").translate(self.letters) for p in pieces]
        ids = {p: np.array(i, np.int32).tobytes() for p, i in zip(pieces, self.model.encode(mapped, num_threads=1), strict=True)}
        return [b"".join([ids[p] for p in parts]) for parts in split]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        split = [units(t) for t in texts]
        known = self.known.of(split)
        return [np.frombuffer(b"".join(map(known, own)), np.int32) for own in split]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@cache
def coder(path: str, pattern: str) -> Coder:
    """The coder of this process; what it knows of pieces serves all its tasks."""
    return Coder(path, pattern)


def encoded(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (),
            decode: bool = False) -> DataFrame:
    """One row per row of `docs`: doc_id, the columns of `keep`, ids (array<int>) and, with `decode`, the bytes they decode to.

    A null text counts as empty and gives no ids; special tokens are not known, their strings are ordinary text. Repeated
    rows give equal rows, an empty table an empty result; other columns are not read. `path` must be readable on every
    executor.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *keep)
    kinds = dict(source.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in ("doc_id", *keep)) + ", ids array<int>" + ", decoded binary" * decode

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                ids = own.encode([t or "" for t in part.column(1).to_pylist()])
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                made = [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))]
                if decode:
                    made.append(pa.array([own.decode(i.tolist()) for i in ids], pa.binary()))
                yield pa.RecordBatch.from_arrays([part.column(0), *part.columns[2:], *made], ["doc_id", *keep, "ids", "decoded"][: 2 + len(keep) + decode])

    return source.mapInArrow(encode, schema)


def decoded(ids: Column, path: str) -> Column:
    """The bytes that ids stand for; null for null."""

    @F.arrow_udf(BinaryType())
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokens = read_ranks(path)
        for ids in batches:
            yield pa.array([None if x is None else b"".join([tokens[i] for i in x]) for x in ids.to_pylist()], pa.binary())

    return decode(ids)
