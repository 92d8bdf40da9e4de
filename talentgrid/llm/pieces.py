"""Splitting of texts into units that pre-token boundaries never cross, and a bounded store of what is known of them."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from itertools import islice

import regex

CACHED_UNITS = 200_000
LONGEST_CACHED = 64

_MIXED = regex.compile(r" \s|\s |^ | $").search
_SINGLE = regex.compile(r"(?<=\S) (?=\S)").split


def units(text: str) -> list[str]:
    """The text cut before each single space between two visible characters; a pre-token never spans such a place."""
    parts = _SINGLE(text) if _MIXED(text) else text.split(" ")
    return [parts[0], *[" " + p for p in parts[1:]]] if text else []


class Known:
    """Values of units, computed for all new ones of a slice at once; the oldest half goes when the store is full."""

    def __init__(self, compute: Callable[[list[str]], Iterable]):
        self.compute = compute
        self.values: dict[str, object] = {}

    def of(self, texts: list[list[str]]) -> Callable[[str], object]:
        """A lookup that knows every unit of `texts`."""
        wanted = set().union(*texts)
        new = [u for u in wanted if u not in self.values]
        found = dict(zip(new, self.compute(new), strict=True)) if new else {}
        short = {u: v for u, v in found.items() if len(u) <= LONGEST_CACHED}
        if len(self.values) + len(short) > CACHED_UNITS:
            current = {u: self.values[u] for u in wanted if u in self.values} | found
            self.values = dict(islice(self.values.items(), len(self.values) // 2, None)) | short
            return current.__getitem__
        self.values |= short
        if len(short) == len(found):
            return self.values.__getitem__
        return lambda u: found[u] if u in found else self.values[u]
