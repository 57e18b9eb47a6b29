"""The words of many texts as one Arrow array, each with the number of its text."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def bytes_of(*ranges: tuple[int, int]) -> np.ndarray:
    """Which of the 256 bytes lie in one of the ranges, both ends included."""
    found = np.zeros(256, bool)
    for low, high in ranges:
        found[low : high + 1] = True
    return found


class Tokens:
    """Runs of bytes that are neither ``gaps`` nor ``breaks`` (ASCII bytes both).

    ``words`` are the runs, with A-Z in lower case, ``text`` their texts' numbers, and
    ``opens`` says which ones begin a piece: a word after a break, or the first of a text.
    """

    def __init__(self, texts: pa.Array, gaps: np.ndarray, breaks: np.ndarray | None = None):
        ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
        body = texts.buffers()[2]
        data = np.frombuffer(body, np.uint8) if body else np.zeros(0, np.uint8)
        data = data[ends[0] : ends[-1]]
        bounds = ends.astype(np.int64) - ends[0]
        data = data + (((data >= 65) & (data <= 90)) * np.uint8(32))
        letter = ~(gaps if breaks is None else gaps | breaks)[data]
        begins, stops = letter.copy(), letter.copy()
        begins[1:] &= ~letter[:-1]
        stops[:-1] &= ~letter[1:]
        inner = bounds[(bounds > 0) & (bounds < len(data))]
        begins[inner] = letter[inner]
        stops[inner - 1] = letter[inner - 1]
        start, end = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        self.text = np.searchsorted(bounds, start, "right") - 1
        offsets = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int32)
        kept = data[letter].tobytes()
        self.words = pa.StringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(kept))
        self.opens = np.ones(len(start), bool)
        self.opens[1:] = self.text[1:] != self.text[:-1]
        if breaks is not None:
            before = np.concatenate([[0], np.cumsum(breaks[data])])
            self.opens[1:] |= before[start[1:]] > before[end[:-1]]
