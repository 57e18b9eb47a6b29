"""Words and word n-grams of many texts at once, as arrays of 64-bit hashes.

A word is a run of bytes other than ASCII white space. It is hashed eight bytes at a time, twice
with unlike multipliers, and the hash of a run of words is put together from those of runs half
as long. Both are mixed at every step: no sum of powers, whose differences vanish modulo 2**64 for
some regular sequences whatever the base. Words of one length up to eight bytes never collide.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa

#: Bytes of text whose words are held at a time; more only where one text is longer.
CHUNK = 2 << 20
SPACES = [9, 10, 11, 12, 13, 32]
#: What the hash so far is multiplied by, in the first hash and in the second.
LEFT, LEFT_TOO = 0xD1342543DE82EF95, 0xAF251AF3B0F025B5


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of a hash over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def runs(values: np.ndarray, n: int, left: int = LEFT) -> np.ndarray:
    """Hashes of all runs of ``n`` values, from those of 1, 2, 4 ... values."""
    count, left = len(values) - n + 1, np.uint64(left)
    found, covered, width, block = None, 0, 1, mix(values)
    while covered < n:
        if n & width:
            part = block[covered : covered + count]
            found = part if found is None else mix(found * left + part)
            covered += width
        if covered < n:
            block = mix(block[:-width] * left + block[width:])
            width *= 2
    return found


def hashed(data: np.ndarray, start: np.ndarray, size: np.ndarray, left: int = LEFT) -> np.ndarray:
    """Hashes of runs of bytes, each from its length and its bytes."""
    left, size = np.uint64(left), size.copy()
    found = mix(size.astype(np.uint64) * left)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eights = np.lib.stride_tricks.as_strided(padded, (len(data) + 1, 8), (1, 1))
    rest, at = np.arange(len(size)), start
    while len(rest):
        part = np.ascontiguousarray(eights[at]).view(np.uint64).ravel()
        short = size[rest] < 8
        keep = (np.uint64(1) << (8 * size[rest][short]).astype(np.uint64)) - np.uint64(1)
        part[short] &= keep
        found[rest] = mix(found[rest] * left + part)
        more = size[rest] > 8
        rest, at = rest[more], at[more] + 8
        size[rest] -= 8
    return found


class Words:
    """The words of some texts: ``start`` and ``end`` in ``data``, ``hash`` and ``hash_too``, ``text`` (its number)."""

    space = np.isin(np.arange(256), SPACES)

    def __init__(self, texts: pa.Array, lower: bool = False):
        ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
        body = texts.buffers()[2]
        data = np.frombuffer(body, np.uint8) if body else np.zeros(0, np.uint8)
        self.data = data[ends[0] : ends[-1]]
        if lower:
            capital = (self.data >= 65) & (self.data <= 90)
            self.data = self.data + (capital * np.uint8(32))
        self.bounds = ends.astype(np.int64) - ends[0]
        letter = ~self.space[self.data]
        begins, stops = letter.copy(), letter.copy()
        begins[1:] &= ~letter[:-1]
        stops[:-1] &= ~letter[1:]
        inner = self.bounds[(self.bounds > 0) & (self.bounds < len(self.data))]
        begins[inner] = letter[inner]
        stops[inner - 1] = letter[inner - 1]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        self.text = np.searchsorted(self.bounds, self.start, "right") - 1
        #: First word of each text, and one past the last.
        self.first = np.searchsorted(self.start, self.bounds)
    @cached_property
    def hash(self) -> np.ndarray:
        return self._hashes(LEFT)

    @cached_property
    def hash_too(self) -> np.ndarray:
        return self._hashes(LEFT_TOO)

    def _hashes(self, left: int) -> np.ndarray:
        return hashed(self.data, self.start, self.end - self.start, left)

    def ngrams(self, n: int, other: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """First words of all n-grams inside one text, and their hashes."""
        if len(self.start) < n:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.text[: len(self.text) - n + 1] == self.text[n - 1 :])
        return at, (runs(self.hash_too, n, LEFT_TOO) if other else runs(self.hash, n))[at]


def chunks(texts: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, pa.Array]]:
    """Slices of at most ``limit`` bytes, or one text, with the number of their first text."""
    if not len(texts):
        return
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + limit, "right")) - 1)
        yield lo, texts.slice(lo, hi - lo)
        lo = hi


def plain(column: pa.ChunkedArray | pa.Array) -> list[pa.Array]:
    """The chunks of a column as 32-bit strings."""
    parts = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    return [p.cast(pa.string()) for p in parts if len(p)]


def bucket_of(hashes: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` equal ranges of hashes; the lower 32 bits stay free."""
    return ((hashes >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)


def planes(values: np.ndarray) -> bytes:
    """The values' first bytes, then their second bytes, and so on: compresses well if small."""
    return values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def unplanes(blob: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.frombuffer(blob, np.uint8).reshape(width, -1).T.copy().view(kind).ravel()
