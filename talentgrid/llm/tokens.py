"""Token counts by prefix dynamic programming over a byte-level merge table.

The encoding of a prefix ends in one token; that token is the only one whose pair with the last token of the shorter
prefix survives re-merging. So last tokens and counts of all prefixes of a piece follow from left to right, a text adds
up its pieces, and any question about a cut of the text is answered from the stored counts.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from functools import cache
from itertools import accumulate
from operator import sub

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from talentgrid.llm.pieces import Known, units

SLICE_ROWS = 512
BATCH_PIECES = 8192
SHORT_PIECE = 24
KNOWN_PAIRS = 2_000_000

_SPACES = re.compile(r"\s\s").search  # white space as str.isspace() has it


def byte_letters() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies, by character."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixCounter:
    """Counts tokens of every prefix of a text for one byte-level tokenizer file (.json)."""

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as f:
            table = json.load(f)
        letters = byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        specials = [t["content"] for t in table["added_tokens"]]
        self.tokens = [raw(t) for t in table["model"]["vocab"] if t not in specials]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in table["model"]["merges"])
        self.ranks = {(raw(a), raw(b)): i for i, (a, b) in enumerate(pairs)}
        self.find = regex.compile(pattern).findall
        self.at_special = regex.compile("|".join(map(regex.escape, specials))) if specials else None
        self._grow_tree()
        self.pairs, self.pair_fits = np.empty(0, np.int64), np.empty(0, bool)
        self.pieces, self.known = Known(self._of_pieces), Known(self._of_units)

    def _grow_tree(self) -> None:
        """Byte tree of the tokens as sorted (node, byte) steps; node 0 is the root."""
        steps: dict[int, int] = {}
        self.token_at = [-1]
        for i, token in enumerate(self.tokens):
            node = 0
            for b in token:
                step = node << 8 | b
                if step not in steps:
                    steps[step] = len(self.token_at)
                    self.token_at.append(-1)
                node = steps[step]
            self.token_at[node] = i
        self.steps = np.array(sorted(steps), np.int64)
        self.nodes = np.array([steps[s] for s in self.steps.tolist()], np.int64)
        self.token_at = np.array(self.token_at, np.int64)

    def merged(self, data: bytes) -> list[bytes]:
        """The tokens of one piece by repeated merging; used to test pairs only."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            ranked = [(self.ranks[p], i) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if p in self.ranks]
            if not ranked:
                break
            _, i = min(ranked)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _may_follow(self, before: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Whether each token can come after another, or first (-1), in an encoding."""
        key = (before + 1) << 32 | token
        at = np.searchsorted(self.pairs, key)
        new = np.unique(key[self.pairs[np.minimum(at, len(self.pairs) - 1)] != key] if len(self.pairs) else key)
        if len(new):
            if len(self.pairs) > KNOWN_PAIRS:
                self.pairs, self.pair_fits, new = self.pairs[:0], self.pair_fits[:0], np.unique(key)
            fits = []
            for k in new.tolist():
                own = [self.tokens[i] for i in ((k >> 32) - 1, k & 0xFFFFFFFF) if i >= 0]
                fits.append(self.merged(b"".join(own)) == own)
            place = np.searchsorted(self.pairs, new)
            self.pairs, self.pair_fits = np.insert(self.pairs, place, new), np.insert(self.pair_fits, place, fits)
            at = np.searchsorted(self.pairs, key)
        return self.pair_fits[at]

    def byte_counts(self, pieces: list[bytes]) -> np.ndarray:
        """Token counts of all byte prefixes of pieces of similar length, one column per piece, the empty prefix first."""
        sizes = np.array([len(p) for p in pieces])
        n, width = len(pieces), int(sizes.max())
        data = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width).T.astype(np.int64)
        ends: list[list[tuple[int, np.ndarray, np.ndarray]]] = [[] for _ in range(width + 1)]
        for start in range(width):
            at, node = np.flatnonzero(sizes > start), 0
            for end in range(start + 1, width + 1):
                step = node << 8 | data[end - 1, at]
                found = np.minimum(np.searchsorted(self.steps, step), len(self.steps) - 1)
                hit = (self.steps[found] == step) & (sizes[at] >= end)
                at, node = at[hit], self.nodes[found[hit]]
                if not len(at):
                    break
                token = self.token_at[node]
                ends[end].append((start, at[token >= 0], token[token >= 0]))
        last = np.full((width + 1, n), -1, np.int64)
        counts = np.zeros((width + 1, n), np.int64)
        for end in range(1, width + 1):
            unsolved = sizes >= end
            for start, at, token in ends[end]:
                left = unsolved[at]
                at, token = at[left], token[left]
                if len(at):
                    fits = self._may_follow(last[start, at], token)
                    at = at[fits]
                    last[end, at], counts[end, at] = token[fits], counts[start, at] + 1
                    unsolved[at] = False
            if unsolved.any():
                raise ValueError("the vocabulary lacks a byte")
        return counts

    def of_pieces(self, pieces: set[str]) -> dict[str, list[int]]:
        """Token counts of all code-point prefixes of each piece."""
        out = {}
        cut = [p for p in pieces if p[0] == "'" and len(p) > 2]  # a contraction that is cut is none
        pieces = pieces | {q for p in cut for k in range(2, len(p)) for q in self.find(p[:k])}
        raw = {p: p.encode() for p in pieces}
        ordered = sorted(pieces, key=lambda p: len(raw[p]))
        begin = 0
        while begin < len(ordered):
            long = len(raw[ordered[begin]]) > SHORT_PIECE
            batch = ordered[begin : begin + (1 if long else BATCH_PIECES)]
            begin += len(batch)
            counts = self._one_long(raw[batch[0]])[None] if long else self.byte_counts([raw[p] for p in batch]).T
            for piece, own in zip(batch, counts.tolist(), strict=True):
                size = len(raw[piece])
                out[piece] = own[1 : size + 1] if size == len(piece) else [own[e] for e in accumulate(len(c.encode()) for c in piece)]
        for p in cut:
            out[p] = [out[p][0], *(sum(out[q][-1] for q in self.find(p[:k])) for k in range(2, len(p))), out[p][-1]]
        return out

    def _one_long(self, data: bytes) -> np.ndarray:
        """Token counts of all byte prefixes of one piece of any length, walking the byte tree from each end's earlier starts."""
        n = len(data)
        tokens: list[list[tuple[int, int]]] = [[] for _ in range(n + 1)]
        values = np.frombuffer(data, np.uint8).astype(np.int64)
        at, node, start = np.arange(n), np.zeros(n, np.int64), np.arange(n)
        while len(at):
            step = node << 8 | values[at]
            found = np.minimum(np.searchsorted(self.steps, step), len(self.steps) - 1)
            hit = self.steps[found] == step
            node, at, start = self.nodes[found[hit]], at[hit] + 1, start[hit]
            token = self.token_at[node]
            for e, s, t in zip(at[token >= 0].tolist(), start[token >= 0].tolist(), token[token >= 0].tolist(), strict=True):
                tokens[e].append((s, t))
            node, start, at = node[at < n], start[at < n], at[at < n]
        last, counts = [-1] * (n + 1), np.zeros(n + 1, np.int64)
        for end in range(1, n + 1):
            for begin, token in reversed(tokens[end]):
                if self._may_follow(np.array([last[begin]]), np.array([token]))[0]:
                    last[end], counts[end] = token, counts[begin] + 1
                    break
            else:
                raise ValueError("the vocabulary lacks a byte")
        return counts

    def _of_pieces(self, new: list[str]) -> list[bytes]:
        """Steps of each piece: by how much the count grows at each code point."""
        known = self.of_pieces(set(new))
        return [array("i", map(sub, known[p], [0, *known[p]])).tobytes() for p in new]

    def _of_units(self, new: list[str]) -> list[bytes]:
        """Steps of each unit. Units differ by marks after a word, so what is known of pieces is kept, too."""
        split = list(map(self.find, new))
        # A run of white space is split before its last character only if more text follows; cut there, it is one piece.
        spaced = [i for i, u in enumerate(new) if _SPACES(u)]
        runs = [[a + b[0] for a, b in zip(split[i], split[i][1:], strict=False) if a.isspace() and b[0].isspace()] for i in spaced]
        known = self.pieces.of([*split, *runs])
        out = [b"".join(map(known, parts)) for parts in split]
        for i in spaced:
            parts, steps, at = split[i], np.frombuffer(out[i], np.int32).copy(), 0
            for before, p in zip(parts, parts[1:], strict=False):
                at += len(before)
                if before.isspace() and p[0].isspace() and at + 1 < len(steps):
                    more = sum(array("i", known(before + p[0]))) - sum(array("i", known(before))) - array("i", known(p))[0]
                    steps[at : at + 2] += np.array([more, -more], np.int32)
            out[i] = steps.tobytes()
        return out

    def _plain(self, text: list[str], known) -> np.ndarray:
        return np.frombuffer(b"".join(map(known, text)), np.int32)

    def growth(self, texts: list[str]) -> list[np.ndarray]:
        """By how much the token count of each text grows at each code point; a special token counts as one, cut it is plain text."""
        parts = []  # of each text: its plain stretches, and between two of them the first one with all but the end of the special token
        for text in texts:
            hits = list(self.at_special.finditer(text)) if self.at_special else []
            starts = [0, *(h.end() for h in hits)]
            parts.append([x for s, h in zip(starts, hits, strict=False) for x in (text[s : h.start()], text[s : h.end() - 1])] + [text[starts[-1] :]])
        split = [[units(x) for x in own] for own in parts]
        known = self.known.of([u for own in split for u in own])
        out = []
        for own, cut in zip(parts, split, strict=True):
            if len(own) == 1:
                out.append(self._plain(cut[0], known))
                continue
            total, each = 0, []
            for k in range(0, len(own) - 1, 2):
                before, longer = np.cumsum(self._plain(cut[k], known)), np.cumsum(self._plain(cut[k + 1], known))
                each += [total + before, total + longer[len(own[k]) :]]
                total += (int(before[-1]) if len(before) else 0) + 1
                each.append(np.array([total]))
            out.append(np.diff(np.concatenate([*each, total + np.cumsum(self._plain(cut[-1], known))]), prepend=0).astype(np.int32))
        return out

    def counts(self, texts: list[str]) -> list[np.ndarray]:
        """Token counts of all code-point prefixes of each text."""
        return [np.cumsum(s) for s in self.growth(texts)]


@cache
def counter(path: str, pattern: str) -> PrefixCounter:
    """The counter of this process; what it knows of pieces serves all its tasks."""
    return PrefixCounter(path, pattern)


def prefix_counts(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
                  budgets: tuple[int, ...] = (), steps: bool = True) -> DataFrame:
    """One row per row of `docs`: doc_id, n_bytes, n_chars, n_tokens, chars_within_<b> for each b of `budgets`, steps.

    `steps`, left out on demand, holds as 16-bit differences in text order the exact token count of every code-point
    prefix; chars_within_<b> is the length of the longest prefix of at most b tokens. A null text counts as empty: zero
    tokens, no steps. Repeated rows give equal rows, an empty table an empty result, and other columns are not read.
    `path` must be readable on every executor.
    """
    kind = dict(docs.dtypes)[id_col]
    names = ["doc_id", "n_bytes", "n_chars", "n_tokens", *(f"chars_within_{b}" for b in budgets)]

    def longest(each: np.ndarray, total: int, budget: int) -> int:
        if total <= budget:
            return len(each)
        fits = np.flatnonzero(np.cumsum(each) <= budget)
        return int(fits[-1]) + 1 if len(fits) else 0

    def packed(each: list[np.ndarray]) -> pa.Array:
        """The steps of all texts in one buffer."""
        ends = np.cumsum([0, *map(len, each)])
        whole = np.concatenate([np.empty(0, np.int32), *each])
        if len(whole) and np.abs(whole).max() >= 1 << 15:
            raise OverflowError("a step exceeds 16 bits")
        return pa.Array.from_buffers(
            pa.large_binary(), len(each), [None, pa.py_buffer((2 * ends).astype(np.int64)), pa.py_buffer(whole.astype("<i2"))]).cast(pa.binary())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                texts = [t or "" for t in part.column(1).to_pylist()]
                each = counter(path, pattern).growth(texts)
                totals = [int(e.sum()) for e in each]
                made = [pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(map(len, texts), pa.int64()),
                        pa.array(totals, pa.int64()), *(pa.array(list(map(longest, each, totals, [b] * len(each))), pa.int64()) for b in budgets)]
                if steps:
                    made.append(packed(each))
                yield pa.RecordBatch.from_arrays([part.column(0), *made], [*names, "steps"][: 1 + len(made)])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        count, f"doc_id {kind}, " + ", ".join(f"{n} long" for n in names[1:]) + ", steps binary" * steps)


def tokens_at(steps: Column, chars: Column) -> Column:
    """Token count of the first `chars` code points; beyond the end, of the whole text."""

    @F.pandas_udf(LongType())
    def answer(steps: pd.Series, chars: pd.Series) -> pd.Series:
        return pd.Series([int(np.frombuffer(s, "<i2")[: max(0, n)].sum()) for s, n in zip(steps, chars, strict=True)], dtype="int64")

    return answer(steps, chars.cast("long"))


def chars_within(steps: Column, budget: int) -> Column:
    """Code points of the longest prefix of at most `budget` tokens."""

    @F.pandas_udf(LongType())
    def answer(steps: pd.Series) -> pd.Series:
        def longest(raw: bytes) -> int:
            fits = np.flatnonzero(np.cumsum(np.frombuffer(raw, "<i2"), dtype=np.int64) <= budget)
            return int(fits[-1]) + 1 if len(fits) else 0

        return pd.Series([longest(s) for s in steps], dtype="int64")

    return answer(steps)
