"""Words of whole Arrow text columns, found and hashed with numpy.

Small helpers for work inside Spark's Python tasks. Hashes have 64 bits and are
the same in every task: each byte's code times a power for its place in the
word, summed and mixed.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa

PIECE = 1 << 20
"""Bytes hashed at a time, which bounds the arrays made on the way."""


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of unsigned 64-bit numbers over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _table(ranges) -> np.ndarray:
    member = np.zeros(256, dtype=bool)
    for low, high in ranges:
        member[low : high + 1] = True
    return member


BLANK_CUT = ~_table([(0x20, 0x20), (0x09, 0x0D)])
"""Bytes of words that end at blanks."""
LETTERS_DIGITS = _table([(0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)])
"""Bytes of words of letters, digits and whatever is not ASCII."""

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
_CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_STEP = 0xD6E8FEB86659FD93


class Words(NamedTuple):
    """Words of a column: word i is data[starts[i]:ends[i]]; text t has the words first[t] to first[t + 1]."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def text(self, i: int) -> str:
        return LOWER[self.data[self.starts[i] : self.ends[i]]].tobytes().decode("utf-8", "replace")

    def hashes(self, lower: bool = True) -> np.ndarray:
        """64-bit hashes of the words, with A-Z lower-cased unless told not to."""
        codes = _CODES[LOWER] if lower else _CODES
        lengths = self.ends - self.starts
        out = np.empty(len(lengths), dtype=np.uint64)
        upto = np.cumsum(lengths)
        low = 0
        while low < len(lengths):
            high = max(low + 1, int(np.searchsorted(upto, (upto[low - 1] if low else 0) + PIECE, side="right")))
            n = lengths[low:high]
            begins = np.cumsum(n) - n
            place = np.arange(int(n.sum())) - np.repeat(begins, n)
            byte = self.data[place + np.repeat(self.starts[low:high], n)]
            out[low:high] = np.add.reduceat(codes[byte] * _powers(int(n.max()))[place], begins)
            low = high
        return mix(out ^ lengths.astype(np.uint64))


_made = np.ones(1, dtype=np.uint64)


def _powers(n: int) -> np.ndarray:
    global _made
    if len(_made) < n:
        steps = np.full(max(n, 2 * len(_made)), _STEP, dtype=np.uint64)
        steps[0] = 1
        _made = np.multiply.accumulate(steps)
    return _made


def column_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and len + 1 offsets into them; null as empty."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return np.empty(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    _, at, body = texts.buffers()
    offsets = np.frombuffer(at, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(body, dtype=np.uint8) if body is not None else np.empty(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def find_words(texts: pa.Array, member: np.ndarray) -> Words:
    """Longest runs of member bytes, none over two texts."""
    data, offsets = column_bytes(texts)
    inside = member[data]
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    filled = offsets[1:] > offsets[:-1]
    heads, tails = offsets[:-1][filled], offsets[1:][filled] - 1
    opens[heads] = inside[heads]
    closes[tails] = inside[tails]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return Words(data, starts, ends, np.searchsorted(starts, offsets))


def pair_hashes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of ordered pairs of hashes."""
    return mix(a * np.uint64(0x9E3779B97F4A7C15) + mix(b + np.uint64(0x632BE59BD9B4E019)))


def slices(texts: pa.Array, limit: int = 8 << 20):
    """(from, to) row ranges of at most so many bytes, one text at least."""
    _, offsets = column_bytes(texts)
    low = 0
    while low < len(texts):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, side="right")) - 1)
        yield low, high
        low = high
