"""Substring dedup by fixed-block anchors.

A window of 35 words holds a whole block of 18 words wherever blocks of 18 are laid end to
end from the start of a text. So of two equal windows one holds a block of its text that the
other has at some place:

1. Every text's blocks are the index; every rolling run of 18 words probes it. Runs that
   meet a block elsewhere are hits.
2. Hits are extended: only windows around a hit are candidates, and those that occur twice
   are the repeats. Overlapping windows join to maximal repeats.

Texts are dealt into parts of the corpus. A part sends a run or window once, with a mark if
it has it twice, and gets back its hits, or the candidates that occur once: a passage that
all documents share is one entry per part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memberlens.llm.scratch import in_parts
from memberlens.llm.words import Words, bucket_of, chunks, plain, planes, unplanes

#: Runs or windows of one part of the corpus that are merged before they are sent.
SENT_TOGETHER = 1 << 20


@dataclass(frozen=True)
class Window:
    words: int = 35

    @property
    def block(self) -> int:
        """The longest block that every window contains, however the two lie."""
        return (self.words + 1) // 2


# What is known of a run: it occurs in the part, twice, as a block.
TWICE, BLOCK = 1, 2


def _merged(hashes: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes, their marks together, and the place of one of each."""
    order = np.argsort(hashes, kind="stable")
    first = np.flatnonzero(np.diff(hashes[order], prepend=hashes[order[:1]] ^ np.uint64(1)))
    both = np.bitwise_or.reduceat(marks[order], first)
    counts = np.diff(np.append(first, len(hashes)))
    return hashes[order[first]], both | np.where(counts > 1, TWICE, 0).astype(np.uint8), order[first]


def _by_bucket(part: int, n: int, hashes: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
    """Rows bucket, part and body for sorted hashes and columns that go with them."""
    buckets = bucket_of(hashes, n)
    cuts = np.flatnonzero(np.diff(buckets)) + 1
    pieces = zip(*(np.split(c, cuts) for c in columns), strict=True)
    bodies = [b"".join(planes(c) for c in piece) for piece in pieces]
    names = buckets[np.concatenate([[0], cuts])].astype(np.int32)
    own = np.full(len(names), part, np.int32)
    return pa.RecordBatch.from_arrays(
        [pa.array(names), pa.array(own), pa.array(bodies, pa.binary())], names=["bucket", "part", "body"]
    )


def _columns(body: bytes, *kinds: type) -> list[np.ndarray]:
    widths = [np.dtype(k).itemsize for k in kinds]
    n, at, found = len(body) // sum(widths), 0, []
    for kind, size in zip(kinds, widths, strict=True):
        found.append(unplanes(body[at : at + n * size], kind))
        at += n * size
    return found


def _runs(words: Words, window: Window) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First words, hashes and marks of all runs of texts that are long enough for a window."""
    at, hashes = words.ngrams(window.block)
    text = words.text[at]
    long = (words.first[text + 1] - words.first[text]) >= window.words
    at, hashes, text = at[long], hashes[long], text[long]
    aligned = (at - words.first[text]) % window.block == 0
    return at, hashes, np.where(aligned, BLOCK, 0).astype(np.uint8)


def _sender(read, n: int):
    """A function for mapInArrow: what ``read`` finds in the texts, merged for each part."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            # A task may get several parts; the texts of each are read together.
            batch = batch.take(pa.array(np.argsort(batch.column(0).to_numpy(), kind="stable")))
            parts = batch.column(0).to_numpy()
            cuts = np.flatnonzero(np.diff(parts)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(parts)], strict=True):
                if hi <= lo:
                    continue
                part = int(parts[lo])
                for body in plain(batch.column(2).slice(lo, hi - lo)):
                    for _, texts in chunks(body):
                        held.setdefault(part, []).append(read(Words(texts)))
                        if sum(len(x[0]) for x in held[part]) > SENT_TOGETHER:
                            yield from _flushed(part, held.pop(part), n)
        for part in list(held):
            yield from _flushed(part, held.pop(part), n)

    return send


def _flushed(part: int, found: list[tuple], n: int) -> Iterator[pa.RecordBatch]:
    hashes, marks = (np.concatenate([x[k] for x in found]) for k in (0, 1))
    if len(hashes):
        hashes, marks, _ = _merged(hashes, marks)
        yield _by_bucket(part, n, hashes, hashes.astype(np.uint32), marks)


def _hits(table: pa.Table) -> pa.Table:
    """Of one bucket: runs that are a block somewhere and occur twice, for each part."""
    hashes, marks, ends = [], [], [0]
    for body in table["body"].to_pylist():
        low, mark = _columns(body, np.uint32, np.uint8)
        hashes.append(low.astype(np.uint64))
        marks.append(mark)
        ends.append(ends[-1] + len(low))
    low = np.concatenate(hashes)
    met, mark, _ = _merged(low, np.concatenate(marks))
    of_entry = mark[np.searchsorted(met, low)] == (TWICE | BLOCK)
    bodies = [planes(low[a:b][of_entry[a:b]].astype(np.uint32)) for a, b in zip(ends, ends[1:], strict=False)]
    return pa.table({"part": table["part"], "bucket": table["bucket"], "body": pa.array(bodies, pa.binary())})


def _single(table: pa.Table) -> pa.Table:
    """Of one bucket: candidates that occur once, for each part."""
    names, others, marks, ends = [], [], [], [0]
    for body in table["body"].to_pylist():
        name, other, mark = _columns(body, np.uint64, np.uint32, np.uint8)
        names.append(name)
        others.append(other)
        marks.append(mark)
        ends.append(ends[-1] + len(name))
    name, other, mark = (np.concatenate(x) for x in (names, others, marks))
    order = np.lexsort((other, name))
    fresh = np.ones(len(name), bool)
    fresh[1:] = (np.diff(name[order]) != 0) | (np.diff(other[order].astype(np.int64)) != 0)
    first = np.flatnonzero(fresh)
    counts = np.diff(np.append(first, len(name)))
    twice = (counts > 1) | (np.bitwise_or.reduceat(mark[order], first) & TWICE > 0)
    once = np.empty(len(name), bool)
    once[order] = np.repeat(~twice, counts)
    bodies = [planes(name[a:b][once[a:b]]) for a, b in zip(ends, ends[1:], strict=False)]
    return pa.table({"part": table["part"], "bucket": table["bucket"], "body": pa.array(bodies, pa.binary())})


def _keys(hashes: np.ndarray, n: int) -> np.ndarray:
    return (bucket_of(hashes, n) << np.uint64(32)) | (hashes & np.uint64(0xFFFFFFFF))


def _answered(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Keys of a part's hits, and names of its candidates that occur once, both sorted."""
    keys, once = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    rows = zip(*(table[c].to_pylist() for c in ("kind", "bucket", "body")), strict=True)
    for kind, bucket, body in rows:
        if kind == 0:
            low = unplanes(body, np.uint32).astype(np.uint64)
            keys.append((np.uint64(bucket) << np.uint64(32)) | low)
        else:
            once.append(unplanes(body, np.uint64))
    return np.unique(np.concatenate(keys)), np.unique(np.concatenate(once))


def _found(words: Words, window: Window, keys: np.ndarray, n: int):
    """Windows around a hit: their first words, their hashes, and which of all windows they are."""
    at, hashes, _ = _runs(words, window)
    wanted = _keys(hashes, n)
    place = np.minimum(np.searchsorted(keys, wanted), max(0, len(keys) - 1))
    hit = np.zeros(len(words.hash) + 1, np.int64)
    if len(keys):
        hit[at[keys[place] == wanted]] = 1
    before = np.concatenate([[0], np.cumsum(hit)])
    starts, names = words.ngrams(window.words)
    near = before[starts + window.words - window.block + 1] > before[starts]
    return starts[near], names[near], near


def without_repeats(
    docs: DataFrame, window: Window = Window(), *, text: str = "text", id: str = "doc_id"
) -> DataFrame:
    """One row per document: id, n_words, n_removed and kept_text.

    Words covered by a window whose words also start elsewhere, in the same document or
    another, are removed, in all places. Kept words are joined by one space. A null text
    has no words, and a text shorter than a window keeps them all. Every row is a document.
    """
    body = F.coalesce(text, F.lit(""))
    key = F.xxhash64(F.col(id), body).alias("key")
    n, dealt = in_parts(docs.select(key, F.col(id).cast("bigint").alias("id"), body.alias("body")), "part")
    row = "bucket int, part int, body binary"
    answer = "part int, bucket int, body binary"

    def probe(words: Words) -> tuple[np.ndarray, np.ndarray]:
        _, hashes, marks = _runs(words, window)
        return hashes, marks

    hits = dealt.mapInArrow(_sender(probe, n), row).groupBy("bucket").applyInArrow(_hits, answer)
    hits = hits.withColumn("kind", F.lit(0))

    def extend(left: pa.Table, right: pa.Table) -> pa.Table:
        keys, _ = _answered(right)
        held = [[np.zeros(0, np.uint64), np.zeros(0, np.uint32)]]
        for piece in plain(left["body"]):
            for _, texts in chunks(piece):
                words = Words(texts)
                _, names, near = _found(words, window, keys, n)
                held.append([names, words.ngrams(window.words, other=True)[1][near].astype(np.uint32)])
        names, others = (np.concatenate([x[k] for x in held]) for k in (0, 1))
        empty = pa.table({"bucket": pa.array([], pa.int32()), "part": pa.array([], pa.int32()), "body": pa.array([], pa.binary())})
        if not len(names):
            return empty
        order = np.lexsort((others, names))
        names, others = names[order], others[order]
        fresh = np.ones(len(names), bool)
        fresh[1:] = (np.diff(names) != 0) | (np.diff(others.astype(np.int64)) != 0)
        first = np.flatnonzero(fresh)
        marks = np.where(np.diff(np.append(first, len(names))) > 1, TWICE, 0).astype(np.uint8)
        own = left["part"][0].as_py()
        return pa.Table.from_batches([_by_bucket(own, n, names[first], names[first], others[first], marks)])

    by_part = dealt.groupBy("part")
    windows = by_part.cogroup(hits.groupBy("part")).applyInArrow(extend, row)
    once = windows.groupBy("bucket").applyInArrow(_single, answer).withColumn("kind", F.lit(1))

    def remove(left: pa.Table, right: pa.Table) -> pa.Table:
        keys, once = _answered(right)
        counts, gone, kept = [], [], []
        for piece in plain(left["body"]):
            for _, texts in chunks(piece):
                words = Words(texts)
                starts, names, _ = _found(words, window, keys, n)
                place = np.minimum(np.searchsorted(once, names), max(0, len(once) - 1))
                starts = starts[once[place] != names] if len(once) else starts
                edge = np.zeros(len(words.hash) + 1, np.int64)
                np.add.at(edge, starts, 1)
                np.add.at(edge, starts + window.words, -1)
                stays = np.cumsum(edge)[:-1] == 0
                left_words = np.concatenate([[0], np.cumsum(stays)])
                blob = words.data.tobytes()
                spans = list(zip(words.start.tolist(), words.end.tolist(), stays.tolist(), strict=True))
                for k in range(len(texts)):
                    a, b = int(words.first[k]), int(words.first[k + 1])
                    counts.append(b - a)
                    gone.append(b - a - int(left_words[b] - left_words[a]))
                    kept.append(b" ".join([blob[s:e] for s, e, stay in spans[a:b] if stay]).decode())
        ids = left["id"] if left.num_rows else pa.array([], pa.int64())
        return pa.table(
            {
                "id": ids,
                "n_words": pa.array(counts, pa.int64()),
                "n_removed": pa.array(gone, pa.int64()),
                "kept_text": pa.array(kept, pa.string()),
            }
        )

    answers = hits.unionByName(once)
    rows = by_part.cogroup(answers.groupBy("part")).applyInArrow(
        remove, "id bigint, n_words bigint, n_removed bigint, kept_text string"
    )
    return rows.withColumnRenamed("id", id)
