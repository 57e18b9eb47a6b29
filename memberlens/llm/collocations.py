"""Collocations from truncated suffix subtrees, built group by group, after ERA.

A suffix is a word and the three after it, as far as its piece goes. All suffixes that begin
with the same words make a subtree, and a phrase's count is the total of the leaves below it.

1. Vertical partitioning. Words are counted; those that begin more suffixes than a share of
   the budget are extended by the next word, and so are the longer prefixes, up to whole
   suffixes. Prefixes are dealt into cells by hash, and neighbouring cells into groups that
   stay within the budget; a cell beyond it is split by further bits.
2. Tasks send the suffixes of some texts, equal ones as one with a count, to their groups, with
   the words that these use: a suffix that a third of the corpus shares is one entry a batch.
   A batch has a piece for nearly every group, and there are more groups the larger the corpus:
   so all pieces of a batch are made, and all of a group are read, as slices of shared arrays.
3. A group sorts its suffixes, which is the subtree in order, and reads off counts. Nodes above
   an extended prefix are in several groups, which add them up.

Phrases are compared as they are, not by hashes: hashes only say where a prefix goes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memberlens.llm.scratch import Scratch
from memberlens.llm.tokens import Tokens, bytes_of
from memberlens.llm.words import chunks, hashed, mix, plain

GAPS = bytes_of((0x20, 0x20), (0x09, 0x09))
BREAKS = bytes_of((0x0A, 0x0D)) | np.isin(np.arange(256), list(b".,;:!?"))
SPACE = 0x20
#: Words of a suffix, and so of the longest phrase.
DEPTH = 4
#: Bytes of text that are split at a time, and words that are counted, or whose suffixes are merged, before they are sent.
TEXT_BYTES = 1 << 20
COUNTED_WORDS = 1 << 20
HELD_WORDS = 1 << 20
#: Bytes of text that weigh as much as a word there, where words are long.
WORD_BYTES = 16
#: Bytes from which on words are hashed one by one.
LONG_WORD = 64
#: Prefixes whose counts a task holds before it sends them.
HELD_PREFIXES = 1 << 18
#: Suffixes that are sent at a time.
SENT_TOGETHER = 1 << 18
#: Suffixes of a piece at most: their words, four each at most, are numbers of 16 bits.
PIECE = 1 << 14
#: Cells whose sizes the driver deals into groups.
CELL_BITS = 12
#: Phrases that a task ranks in the first of two rounds, about.
RANKED_TOGETHER = 1 << 18
ODD = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Mining:
    """Phrases of 2 to 4 words that occur ``least`` times; a longer phrase with ``percent`` of a
    phrase's count replaces it; a group's subtrees have about ``budget`` suffixes."""

    least: int = 30
    percent: int = 80
    top: int = 2000
    budget: int = 1 << 19

    @property
    def hot(self) -> int:
        """A prefix of more suffixes than this is extended."""
        return self.budget // 4


Batch = tuple[str, pa.StringArray, np.ndarray, np.ndarray]


def _read(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[Batch]:
    """lang, distinct words, the number of each word in turn, and whether it opens a piece.

    About ``most`` words are held; when there are more, the language that has most of them goes.
    """
    held: dict[str, list] = {}
    sizes: dict[str, int] = {}

    def taken(lang: str) -> Iterator[Batch]:
        parts = held.pop(lang)
        del sizes[lang]
        coded = pa.concat_arrays([w for w, _ in parts]).dictionary_encode()
        if len(coded):
            yield lang, coded.dictionary, coded.indices.to_numpy(), np.concatenate([o for _, o in parts])

    size = 0
    for batch in batches:
        langs = batch.column(0).dictionary_encode()
        codes = langs.indices.to_numpy()
        for code, lang in enumerate(langs.dictionary.to_pylist()):
            for part in plain(batch.column(1).filter(pa.array(codes == code))):
                for _, texts in chunks(part, TEXT_BYTES):
                    found = Tokens(texts, GAPS, BREAKS)
                    held.setdefault(lang, []).append((found.words, found.opens))
                    own = max(len(found.words), found.words.nbytes // WORD_BYTES)
                    sizes[lang] = sizes.get(lang, 0) + own
                    size += own
                    while size > most:
                        largest = max(sizes, key=sizes.get)
                        size -= sizes[largest]
                        yield from taken(largest)
    for lang in list(held):
        yield from taken(lang)


def _hashes(lang: str, words: pa.StringArray) -> np.ndarray:
    """A hash of each word in its language; the first stands for no word."""
    seed = xxhash.xxh3_64_intdigest(lang)
    ends, data = _buffers(words)
    size = np.diff(ends)
    long = np.flatnonzero(size >= LONG_WORD)
    size[long] = 0
    found = mix(hashed(data, ends[:-1], size) ^ np.uint64(seed))
    found[long] = [xxhash.xxh3_64_intdigest(data[ends[k] : ends[k + 1]].tobytes(), seed) for k in long.tolist()]
    return np.concatenate([[np.uint64(seed)], found])


def _buffers(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where values of an array of strings or binaries end, and the first begins, in their bytes."""
    ends = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64)
    body = values.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body else np.zeros(0, np.uint8)
    return ends - ends[0], data[ends[0] : ends[-1]]


def _distinct(w: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct columns of ``w`` in order of their first row, second row and so on, with their counts added up."""
    if not w.shape[1]:
        return w, np.zeros(0, np.int64)

    def packed(rows: np.ndarray, bits: list[int]) -> np.ndarray:
        key = rows[0].astype(np.uint64)
        for row, own in zip(rows[1:], bits[1:], strict=True):
            key <<= np.uint64(own)
            key |= row.astype(np.uint64)
        return key

    def widths(rows: np.ndarray) -> list[int]:
        return [int(row.max()).bit_length() for row in rows]

    low = w
    if sum(widths(w)) > 64:
        low = np.stack([(np.cumsum(np.bincount(row) > 0) - 1)[row] for row in w])
    if sum(widths(low)) <= 64:
        key = packed(low, widths(low))
    else:
        key = packed(np.stack([np.unique(packed(low[k : k + 2], [32, 32]), return_inverse=True)[1] for k in (0, 2)]), [32, 32])
    order = np.argsort(key)
    key = key[order]
    fresh = np.ones(len(key), bool)
    fresh[1:] = key[1:] != key[:-1]
    first = np.flatnonzero(fresh)
    if counts is None:
        return w[:, order[first]], np.diff(np.append(first, len(key)))
    return w[:, order[first]], np.add.reduceat(counts[order], first)


def _suffixes(ids: np.ndarray, opens: np.ndarray) -> np.ndarray:
    """Suffixes of two words at least, as numbers from 1; 0 where the piece has ended."""
    n = len(ids)
    w = np.zeros((DEPTH, n), np.int32)
    w[0] = ids + 1
    inside = np.ones(n, bool)
    for j in range(1, min(DEPTH, n)):
        inside[: n - j] &= ~opens[j:]
        inside[n - j :] = False
        np.multiply(w[0, j:], inside[: n - j], out=w[j, : n - j])
    return w[:, w[1] > 0]


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _prefixes(w: np.ndarray, hashes: np.ndarray, hot: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each suffix's prefix and how many words the prefix has."""
    found, depth = hashes[w[0]], np.ones(w.shape[1], np.int8)
    longer = np.flatnonzero(_among(hashes, hot[0])[w[0]]) if hot else ()
    for words, known in enumerate(hot, 1):
        if words > 1:
            longer = longer[_among(found[longer], known)]
        found[longer] = mix(found[longer] * ODD + hashes[w[words, longer]])
        depth[longer] = words + 1
    return found, depth


def _cells(prefixes: np.ndarray) -> np.ndarray:
    return (prefixes >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def _word_counts(texts: DataFrame) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, words, ids, _ in _read(batches, COUNTED_WORDS):
            hashes = _hashes(lang, words)[1:].view(np.int64)
            counts = np.bincount(ids, minlength=len(words))
            own = pa.array([lang]).take(pa.array(np.zeros(len(words), np.int64)))
            yield pa.RecordBatch.from_arrays(
                [own, words, pa.array(hashes), pa.array(counts, pa.int64())], names=["lang", "phrase", "prefix", "f"]
            )

    rows = texts.mapInArrow(count, "lang string, phrase string, prefix bigint, f bigint")
    return rows.groupBy("lang", "phrase", "prefix").agg(F.sum("f").alias("f"))


def _longer_prefixes(texts: DataFrame, hot: list[np.ndarray]) -> DataFrame:
    """Of prefixes by one word longer than the last that were extended: how many suffixes they begin.

    Rows with a cell have the sum of its prefixes, rows with a prefix those that may be
    extended in turn: no other ends in a word that is not frequent enough itself.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(1 << CELL_BITS, np.int64)
        held, size = [], 0

        def rows(cell, prefix, f) -> pa.RecordBatch:
            names = ["cell", "prefix", "f"]
            return pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(prefix, pa.int64()), pa.array(f, pa.int64())], names=names)

        def flush() -> pa.RecordBatch:
            names, place = np.unique(np.concatenate([n for n, _ in held]), return_inverse=True)
            sums = np.bincount(place, np.concatenate([c for _, c in held]), len(names)).astype(np.int64)
            return rows([None] * len(names), names.view(np.int64), sums)

        for lang, words, ids, opens in _read(batches, HELD_WORDS):
            hashes, w = _hashes(lang, words), _suffixes(ids, opens)
            found, depth = _prefixes(w, hashes, hot)
            new = depth == len(hot) + 1
            cells += np.bincount(_cells(found[new]), minlength=len(cells))
            often = _among(hashes, hot[0])[w[len(hot)]] & new
            held.append(np.unique(found[often], return_counts=True))
            size += len(held[-1][0])
            if size > HELD_PREFIXES:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()
        at = np.flatnonzero(cells)
        yield rows(at, [None] * len(at), cells[at])

    sent = texts.mapInArrow(count, "cell int, prefix bigint, f bigint")
    return sent.groupBy("cell", "prefix").agg(F.sum("f").alias("f"))


@dataclass
class Directory:
    """Which prefixes are extended, and which groups the cells of the others have."""

    hot: list[np.ndarray]
    first: np.ndarray
    parts: np.ndarray

    def group(self, prefixes: np.ndarray) -> np.ndarray:
        cell = _cells(prefixes)
        return self.first[cell] + ((prefixes & np.uint64(0xFFFFFFFF)) % self.parts[cell]).astype(np.int64)


def partitioned(texts: DataFrame, words: DataFrame, mining: Mining, scratch: Scratch) -> Directory:
    """Extends prefixes until none is over its share of the budget, and deals cells into groups.

    The driver sees extended prefixes, of which all suffixes make ``3 * total / hot`` at most, and cells.
    """
    hot: list[np.ndarray] = []
    sizes = np.zeros(1 << CELL_BITS, np.int64)
    level = words.groupBy("prefix").agg(F.sum("f").alias("f"))
    cell = F.shiftrightunsigned("prefix", 64 - CELL_BITS).cast("int").alias("cell")
    for depth in range(1, DEPTH + 1):
        level = scratch.saved(level)
        large = (F.col("f") > mining.hot) & F.lit(depth < DEPTH)
        extended = level.filter(F.col("prefix").isNotNull() & large).select("prefix", "f")
        if depth == 1:
            cells = level.groupBy(cell).agg(F.sum("f").alias("f")).toArrow()
        else:
            cells = level.filter("cell is not null").select("cell", "f").toArrow()
        sizes[cells["cell"].to_numpy()] += cells["f"].to_numpy()
        found = extended.toArrow()
        if not found.num_rows:
            break
        names = found["prefix"].to_numpy().view(np.uint64)
        np.subtract.at(sizes, _cells(names), found["f"].to_numpy())
        hot.append(np.sort(names))
        level = _longer_prefixes(texts, hot)
    parts = np.maximum(1, -(-sizes // mining.budget))
    first, group, room = np.zeros(len(sizes), np.int64), 0, mining.budget
    for at, size in enumerate(sizes.tolist()):
        if size > room:
            group, room = group + 1, mining.budget
        first[at] = group
        room -= size
        if parts[at] > 1:
            group, room = group + int(parts[at]), mining.budget
    return Directory(hot, first, parts.astype(np.uint64))


KINDS = {"group": pa.int64(), "lang": pa.string()} | dict.fromkeys(["words", *(f"w{j}" for j in range(DEPTH)), "leaves"], pa.binary())
SENT = "group bigint, lang string, words binary, " + "".join(f"w{j} binary, " for j in range(DEPTH)) + "leaves binary"


def _pieces(lang: str, spelled: pa.StringArray, group: np.ndarray, w: np.ndarray, leaves: np.ndarray) -> pa.RecordBatch:
    """The suffixes, which are in order of their groups, a row for each group and ``PIECE`` suffixes.

    ``words`` are those of the piece, each with a space after it; ``w0`` to ``w3`` say which of
    them the suffixes have. ``spelled`` has them all, with the space.
    """
    n = len(group)
    run = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    at = np.arange(n) - np.repeat(run, np.diff(np.append(run, n)))
    first = np.flatnonzero(at % PIECE == 0)
    piece = np.repeat(np.arange(len(first)), np.diff(np.append(first, n)))
    # In order of the suffixes, so that numbers of new words go up from piece to piece.
    coded = pa.array((piece * len(spelled) + w).T.ravel()).dictionary_encode()
    numbers = coded.indices.to_numpy().reshape(n, DEPTH)
    begin = numbers[first, 0]
    numbers = (numbers - begin[piece][:, None]).astype(np.uint16)
    used = spelled.take(pa.array(coded.dictionary.to_numpy() % len(spelled)))
    ends, data = _buffers(used)

    def sliced(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
        values = np.ascontiguousarray(values)
        bounds = pa.py_buffer((bounds * values.itemsize).astype(np.int32))
        return pa.Array.from_buffers(pa.binary(), len(first), [None, bounds, pa.py_buffer(values)])

    bounds = np.append(first, n)
    columns = {
        "group": pa.array(group[first]),
        "lang": pa.array([lang]).take(pa.array(np.zeros(len(first), np.int64))),
        "words": sliced(data, ends[np.append(begin, len(used))]),
        **{f"w{j}": sliced(numbers[:, j], bounds) for j in range(DEPTH)},
        "leaves": sliced(leaves, bounds),
    }
    return pa.RecordBatch.from_arrays([columns[c] for c in KINDS], names=list(KINDS))


def _sent(texts: DataFrame, directory) -> DataFrame:
    """The suffixes of each batch in pieces by group and language.

    ``leaves`` has four times the count of each suffix, and one less than the words of its prefix.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Directory = directory.value
        for lang, words, ids, opens in _read(batches, HELD_WORDS):
            w, counts = _distinct(_suffixes(ids, opens))
            if not w.shape[1]:
                continue
            found, depth = _prefixes(w, _hashes(lang, words), known.hot)
            leaves = (counts * DEPTH + depth - 1).astype(np.uint32)
            group = known.group(found)
            order = np.argsort(group, kind="stable")
            spelled = pc.binary_join_element_wise(pa.concat_arrays([pa.array([""]), words]), "", chr(SPACE))
            for lo in range(0, len(order), SENT_TOGETHER):
                at = order[lo : lo + SENT_TOGETHER]
                yield _pieces(lang, spelled, group[at], w[:, at], leaves[at])

    return texts.mapInArrow(send, SENT)


def _subtree(pieces: pa.Table) -> tuple[pa.StringArray, np.ndarray, np.ndarray, np.ndarray]:
    """The words, suffixes, counts and numbers of words of the prefixes, of what several batches sent."""

    def joined(name: str, kind: type) -> tuple[np.ndarray, np.ndarray]:
        """The values of all pieces, and how many each has."""
        found = [_buffers(chunk.cast(pa.binary())) for chunk in pieces[name].chunks if len(chunk)]
        sizes = np.concatenate([np.diff(ends) for ends, _ in found])
        return np.concatenate([data for _, data in found]).view(kind), sizes // np.dtype(kind).itemsize

    text, sizes = joined("words", np.uint8)
    spaces = np.flatnonzero(text == SPACE)
    ends = np.append(0, spaces - np.arange(len(spaces))).astype(np.int32)
    spelled = pa.StringArray.from_buffers(len(spaces), pa.py_buffer(ends), pa.py_buffer(text[text != SPACE]))
    # The empty word comes first: it has the number 0, which stands for no word.
    coded = pa.concat_arrays([pa.array([""]), spelled]).dictionary_encode()
    numbers = coded.indices.to_numpy()[1:]
    leaves, sizes_too = joined("leaves", np.uint32)
    begin = np.repeat(np.searchsorted(spaces, np.cumsum(sizes) - sizes), sizes_too)
    w = np.stack([numbers[begin + joined(f"w{j}", np.uint16)[0]] for j in range(DEPTH)])
    return coded.dictionary, w, (leaves // DEPTH).astype(np.int64), leaves % DEPTH + 1


def _phrases(sent: DataFrame, least: int) -> DataFrame:
    """lang, phrase and f of all phrases of two words and more that occur ``least`` times."""

    def subtrees(table: pa.Table) -> Iterator[tuple]:
        for lang in pc.unique(table["lang"]):
            words, w, counts, depths = _subtree(table.filter(pc.equal(table["lang"], lang)))
            for depth in np.unique(depths).tolist():
                own = depths == depth
                yield lang.as_py(), depth, words, *_distinct(w[:, own], counts[own])

    def build(table: pa.Table) -> pa.Table:
        found = [pa.table({"lang": pa.array([], pa.string()), "phrase": pa.array([], pa.string()), "f": pa.array([], pa.int64())})]
        for lang, depth, words, w, counts in subtrees(table):
            fresh = np.zeros(w.shape[1], bool)
            fresh[0] = True
            fresh[1:] |= w[0][1:] != w[0][:-1]
            for k in range(2, DEPTH + 1):
                fresh[1:] |= w[k - 1][1:] != w[k - 1][:-1]
                nodes = np.flatnonzero(fresh)
                totals = np.add.reduceat(counts, nodes)
                # Above an extended prefix, other groups have leaves of the node too.
                good = (w[k - 1][nodes] > 0) & ((totals >= least) | (k < depth))
                at, totals = nodes[good], totals[good]
                names = [words.take(pa.array(w[j][at])) for j in range(k)]
                phrase = pc.binary_join_element_wise(*names, " ")
                own = pa.array([lang]).take(pa.array(np.zeros(len(at), np.int64)))
                found.append(pa.table({"lang": own, "phrase": phrase, "f": pa.array(totals, pa.int64())}))
        return pa.concat_tables(found)

    rows = sent.groupBy("group").applyInArrow(build, "lang string, phrase string, f bigint")
    return rows.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).filter(F.col("f") >= least)


def _size(phrase: str) -> F.Column:
    return F.size(F.split(phrase, " "))


def _scored(candidates: DataFrame, phrases: DataFrame) -> DataFrame:
    """lang, phrase, a, and of the cut with the lowest score: score, l and r."""
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), _size("phrase") - 1)))
    cuts = cuts.withColumn("left", F.expr("substring_index(phrase, ' ', k)"))
    cuts = cuts.withColumn("right", F.expr("substring(phrase, length(left) + 2)"))
    for part, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(phrases.select("lang", F.col("phrase").alias(part), F.col("f").alias(name)), ["lang", part])
    whole = "cast((cast(2000000 as decimal(7,0)) * cast(a as decimal(19,0))) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0))) as bigint)"
    cut = F.struct(F.expr(whole).alias("score"), "k", "l", "r")
    best = cuts.select("lang", "phrase", "a", cut.alias("cut")).groupBy("lang", "phrase", "a").agg(F.min("cut").alias("cut"))
    return best.select("lang", "phrase", "a", "cut.score", "cut.l", "cut.r")


def _kept(candidates: DataFrame, percent: int) -> DataFrame:
    """The candidates without those that a longer one replaces."""
    words = F.split("phrase", " ")
    inner = F.expr(
        "flatten(transform(sequence(2, size(words) - 1), k ->"
        " transform(sequence(1, size(words) - k + 1), s -> array_join(slice(words, s, k), ' '))))"
    )
    longer = candidates.withColumn("words", words).filter(F.size("words") > 2)
    inside = longer.select("lang", F.explode(inner).alias("phrase"), F.col("a").alias("longer"))
    most = inside.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    wide = {c: F.col(c).cast("decimal(19,0)") for c in ("a", "longer")}
    gone = F.coalesce(100 * wide["longer"] >= percent * wide["a"], F.lit(False))
    return candidates.join(most, ["lang", "phrase"], "left").filter(~gone).drop("longer")


def _top(rows: DataFrame, top: int) -> DataFrame:
    """The first of each language; in parts before, so that no task ranks all of a language."""
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    parts = max(1, math.ceil(rows.count() / RANKED_TOGETHER))
    part = F.pmod(F.xxhash64("phrase"), F.lit(parts))
    first = rows.withColumn("part", part)
    first = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order)))
    first = first.filter(F.col("rank") <= top).drop("rank", "part")
    last = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    return last.filter(F.col("rank") <= top)


def mined(docs: DataFrame, mining: Mining = Mining(), *, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score: the best collocations of each language.

    ``a`` is how often the phrase occurs, ``l`` and ``r`` its parts at the cut with the lowest
    score, ``n`` all words of the language. A null language is ``und``; null and empty texts
    have no words, and texts of one word a piece no phrases. Rows that repeat count each.
    Other columns are not looked at. Empty tables give no rows.
    """
    spark = docs.sparkSession
    scratch, kept = Scratch(spark), Scratch(spark)
    texts = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.coalesce(text, F.lit("")).alias("body"))
    try:
        words = scratch.saved(_word_counts(texts))
        directory = partitioned(texts, words, mining, scratch)
        sent = _sent(texts, spark.sparkContext.broadcast(directory))
        candidates = scratch.saved(_phrases(sent, mining.least)).withColumnRenamed("f", "a")
        single = words.select("lang", "phrase", "f").filter(F.col("f") >= mining.least)
        phrases = single.unionByName(candidates.withColumnRenamed("a", "f"))
        scored = scratch.saved(_scored(_kept(candidates, mining.percent), phrases))
        n = scratch.saved(words.groupBy("lang").agg(F.sum("f").alias("n")))
        rows = _top(scored, mining.top).join(n, "lang")
        return kept.saved(rows.select(F.col("lang").alias(lang), "rank", "phrase", "a", "l", "r", "n", "score"))
    finally:
        scratch.remove()
