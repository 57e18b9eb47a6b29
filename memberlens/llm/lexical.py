"""Ranked lexical search in buckets by vector length, after LEMP.

A document is the vector of its terms' impacts, a query that of its terms' weights, and a
score is their product. Only terms of some query count, so a document's vector holds no
others: no product changes, and vectors get shorter.

1. Vectors are ordered by length (range-partitioned); neighbours form buckets.
2. Queries meet the longest sixteenth first; the k-th best score so far is what the rest
   must reach. A bucket whose longest vector times the query's length stays below that is
   skipped (Cauchy-Schwarz).
3. Inside a bucket the query's terms are taken in the order of the most they can add there,
   until all others together, by their maxima in the bucket or by length, can add too little: only
   documents with one of the terms taken are candidates, and of those only the ones whose
   sum so far plus that bound reaches far enough.
4. What is left is scored exactly, in 64-bit integers.

Bounds only skip what cannot be among the k best. Queries go over the documents in blocks
of a bounded size, which tasks get as a broadcast; equal query texts are one query.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memberlens.llm.scratch import Scratch
from memberlens.llm.tokens import Tokens, bytes_of
from memberlens.llm.words import chunks, plain

#: ASCII bytes that are no part of a term: all but digits and letters.
GAPS = bytes_of((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))
#: Bytes of distinct query terms that are broadcast at a time; more only for a single query.
BLOCK_BYTES = 32 << 20
#: Bytes that an entry of a query's vector takes besides its term.
ENTRY_BYTES = 64
#: Bytes of text that are split into terms at a time; more only where one text is longer.
TEXT_BYTES = 4 << 20
#: Vector entries that a task holds at a time, documents in a bucket, and how unlike their lengths may be.
HELD_ENTRIES = 2 << 20
BUCKET_DOCS = 4096
BUCKET_RATIO = 0.8
#: The part of the documents, the longest vectors, that sets the score to reach.
HEAD = 1 / 16
#: Room for rounding in bounds, which are doubles.
SLACK = 1 + 1e-9


def term_weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impacts(times: np.ndarray, n: np.ndarray, n_docs: int, all_terms: int) -> np.ndarray:
    """What one occurrence pattern adds per unit of weight; ``n`` is the document's number of terms."""
    if int(n.max(initial=0)) * 75 * n_docs >= 1 << 63:
        share = np.array([75 * int(k) * n_docs // all_terms for k in n], np.int64)
    else:
        share = 75 * n * n_docs // all_terms
    return 1_000_000_000 * times // (1000 * times + 8 * (100 - 75 + share))


def _entries(texts: DataFrame) -> DataFrame:
    """query (a text's digest), term and times, from query and body."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in plain(batch.column(1)):
                for _, some in chunks(part, TEXT_BYTES):
                    found = Tokens(some, GAPS)
                    coded = found.words.dictionary_encode()
                    ids = coded.indices.to_numpy()
                    key, times = np.unique(found.text * max(1, len(coded.dictionary)) + ids, return_counts=True)
                    owner, term = np.divmod(key, max(1, len(coded.dictionary)))
                    names = batch.column(0).slice(at, len(some)).take(pa.array(owner))
                    yield pa.RecordBatch.from_arrays(
                        [names, coded.dictionary.take(pa.array(term)), pa.array(times, pa.int64())],
                        names=["query", "term", "times"],
                    )
                    at += len(some)

    return texts.mapInArrow(count, "query string, term string, times bigint")


def _in_blocks(entries: DataFrame) -> tuple[int, DataFrame]:
    """The number of blocks, and the entries with their block: none is larger than the bound
    but for one that a single query fills."""
    n = 1
    while True:
        dealt = entries.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(n)).cast("int"))
        size = F.sum(F.octet_length("term") + ENTRY_BYTES).alias("size")
        sizes = dealt.groupBy("block").agg(size, (F.min("query") != F.max("query")).alias("several"))
        if sizes.filter((F.col("size") > BLOCK_BYTES) & F.col("several")).isEmpty():
            return n, dealt
        n *= 2


@dataclass
class Queries:
    """The queries of a block as sparse vectors over the block's terms."""

    names: list[str]
    vocabulary: pa.Array
    first: np.ndarray
    terms: np.ndarray
    times: np.ndarray

    @classmethod
    def of(cls, table: pa.Table) -> Queries:
        table = table.sort_by("query").combine_chunks()
        coded = pc.dictionary_encode(table["term"]).combine_chunks()
        names = pc.dictionary_encode(table["query"]).combine_chunks()
        owner = names.indices.to_numpy()
        first = np.searchsorted(owner, np.arange(len(names.dictionary) + 1))
        return cls(names.dictionary.to_pylist(), coded.dictionary, first, coded.indices.to_numpy(), table["times"].to_numpy())


def _vectors(docs: DataFrame, vocabulary, *, text: str, id: str) -> DataFrame:
    """id, n, terms and times: each document's number of terms, and those of the vocabulary."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        for batch in batches:
            at = 0
            for part in plain(batch.column(1)):
                for _, some in chunks(part, TEXT_BYTES):
                    found = Tokens(some, GAPS)
                    ids = pc.index_in(found.words, value_set=known)
                    here = ids.is_valid().to_numpy(zero_copy_only=False)
                    ids = ids.fill_null(0).to_numpy()[here].astype(np.int64)
                    key, times = np.unique(found.text[here] * len(known) + ids, return_counts=True)
                    owner, term = np.divmod(key, len(known))
                    ends = pa.array(np.searchsorted(owner, np.arange(len(some) + 1)), pa.int32())
                    n = np.bincount(found.text, minlength=len(some))
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).slice(at, len(some)),
                            pa.array(n, pa.int64()),
                            pa.ListArray.from_arrays(ends, pa.array(term, pa.int32())),
                            pa.ListArray.from_arrays(ends, pa.array(times, pa.int64())),
                        ],
                        names=["id", "n", "terms", "times"],
                    )
                    at += len(some)

    read = docs.select(F.col(id).cast("bigint").alias("id"), F.coalesce(text, F.lit("")).alias("body"))
    return read.mapInArrow(scan, "id bigint, n bigint, terms array<int>, times array<bigint>")


def _frequencies(vectors: DataFrame, size: int) -> np.ndarray:
    """In how many documents each term of the vocabulary occurs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(size, np.int64)
        for batch in batches:
            found += np.bincount(batch.column(0).flatten().to_numpy(), minlength=size)
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(found[at])], names=["term", "df"])

    rows = vectors.select("terms").mapInArrow(count, "term int, df bigint")
    table = rows.groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    df = np.zeros(size, np.int64)
    df[table["term"].to_numpy()] = table["df"].to_numpy()
    return df


def _by_length(vectors: DataFrame, n_docs: int, all_terms: int) -> DataFrame:
    """id, terms, impacts and length of documents with a term of some query, longest together."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            n = np.repeat(batch.column(1).to_numpy(), np.diff(ends))
            found = impacts(batch.column(3).flatten().to_numpy(), n, n_docs, all_terms)
            squares = np.concatenate([[0.0], np.cumsum(found.astype(np.float64) ** 2)])
            length = np.sqrt(np.maximum(squares[ends[1:]] - squares[ends[:-1]], 0)) * SLACK
            values = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(found, pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), lists, values, pa.array(length)], names=["id", "terms", "impacts", "length"]
            )

    rows = vectors.filter(F.size("terms") > 0).mapInArrow(
        measure, "id bigint, terms array<int>, impacts array<int>, length double"
    )
    # Vectors of one length, copies say, are spread by their ids.
    return rows.repartitionByRange(F.desc("length"), F.xxhash64("id", F.monotonically_increasing_id()))


@dataclass
class Bucket:
    """Vectors of similar length: by document, and by term."""

    ids: np.ndarray
    ends: np.ndarray
    terms: np.ndarray
    impacts: np.ndarray
    longest: float

    def __post_init__(self):
        order = np.argsort(self.terms, kind="stable")
        owner = np.repeat(np.arange(len(self.ids)), np.diff(self.ends))
        self.by_term, self.doc, self.impact = self.terms[order], owner[order], self.impacts[order]
        self.distinct, self.first = np.unique(self.by_term, return_index=True)
        self.most = np.maximum.reduceat(self.impact, self.first)
        self.stop = np.append(self.first[1:], len(order))

    def candidates(self, terms: np.ndarray, weights: np.ndarray, goal: int) -> np.ndarray:
        """Documents that may score ``goal`` at least."""
        place = np.minimum(np.searchsorted(self.distinct, terms), len(self.distinct) - 1)
        here = (self.distinct[place] == terms) & (weights > 0)
        place, weights = place[here], weights[here].astype(np.float64)
        adds = weights * self.most[place]
        order = np.argsort(-adds, kind="stable")
        place, weights, adds = place[order], weights[order], adds[order]
        by_maxima = np.append(np.cumsum(adds[::-1])[::-1], 0)
        by_length = np.sqrt(np.append(np.cumsum(weights[::-1] ** 2)[::-1], 0)) * self.longest
        rest = np.minimum(by_maxima, by_length) * SLACK
        # All that are left after these terms cannot reach the goal without one of them.
        taken = int(np.argmax(rest < goal)) if goal > 0 else len(place)
        if not taken:
            return np.zeros(0, np.int64)
        runs = [slice(self.first[p], self.stop[p]) for p in place[:taken]]
        doc = np.concatenate([self.doc[r] for r in runs])
        sums = np.concatenate([self.impact[r] * w for r, w in zip(runs, weights[:taken], strict=True)])
        partial = np.bincount(doc, sums, len(self.ids))
        return np.flatnonzero((partial > 0) & (partial * SLACK + rest[taken] >= goal))

    def scores(self, docs: np.ndarray, dense: np.ndarray) -> np.ndarray:
        """Exact scores of some documents by a query's dense vector of weights."""
        lows, sizes = self.ends[docs], self.ends[docs + 1] - self.ends[docs]
        before = np.cumsum(sizes) - sizes
        at = np.arange(int(sizes.sum())) + np.repeat(lows - before, sizes)
        return np.add.reduceat(dense[self.terms[at]] * self.impacts[at], before)


def _buckets(batches: list[pa.RecordBatch]) -> Iterator[Bucket]:
    table = pa.Table.from_batches(batches).sort_by([("length", "descending")]).combine_chunks()
    length = table["length"].to_numpy()
    lists, values = table["terms"].chunk(0), table["impacts"].chunk(0)
    ends = lists.offsets.to_numpy().astype(np.int64)
    terms, found = lists.values.to_numpy(), values.values.to_numpy().astype(np.int64)
    ids = table["id"].fill_null(np.iinfo(np.int64).max).to_numpy()
    lo = 0
    while lo < len(length):
        alike = int(np.searchsorted(-length, -length[lo] * BUCKET_RATIO, "right"))
        hi = max(lo + 1, min(lo + BUCKET_DOCS, alike))
        a, b = ends[lo], ends[hi]
        yield Bucket(ids[lo:hi], ends[lo : hi + 1] - a, terms[a:b], found[a:b], float(length[lo]))
        lo = hi


def _searched(rows: DataFrame, queries, k: int) -> DataFrame:
    """query (its number), id, score: a task's k best for each query, of those that reach its goal."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, weights, goals = queries.value
        goals = goals.copy()
        whole = weights[block.terms] * block.times
        spans = [slice(a, b) for a, b in zip(block.first, block.first[1:], strict=False)]
        lengths = np.array([math.sqrt(float((whole[s].astype(np.float64) ** 2).sum())) for s in spans])
        best = {}
        dense = np.zeros(len(block.vocabulary), np.int64)

        def meet(bucket: Bucket) -> None:
            for q in np.flatnonzero(lengths * bucket.longest * SLACK >= goals):
                terms, own = block.terms[spans[q]], whole[spans[q]]
                docs = bucket.candidates(terms, own, int(goals[q]))
                if not len(docs):
                    continue
                dense[terms] = own
                scores = bucket.scores(docs, dense)
                dense[terms] = 0
                enough = scores >= max(1, goals[q])
                scores, ids = scores[enough], bucket.ids[docs[enough]]
                if q in best:
                    scores, ids = (np.concatenate(x) for x in zip(best[q], (scores, ids), strict=True))
                order = np.lexsort((ids, -scores))[:k]
                best[q] = scores[order], ids[order]
                if len(order) == k:
                    goals[q] = max(goals[q], scores[order[-1]])

        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += len(batch.column(1).flatten())
            if size > HELD_ENTRIES:
                for bucket in _buckets(held):
                    meet(bucket)
                held, size = [], 0
        for bucket in _buckets(held) if size else ():
            meet(bucket)
        for q, (scores, ids) in best.items():
            missing = pa.array(ids, pa.int64(), mask=ids == np.iinfo(np.int64).max)
            own = pa.array(np.full(len(ids), q), pa.int32())
            yield pa.RecordBatch.from_arrays([own, missing, pa.array(scores)], names=["query", "id", "score"])

    return rows.mapInArrow(search, "query int, id bigint, score bigint")


def _best(found: DataFrame, k: int) -> DataFrame:
    first = Window.partitionBy("query").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k)


def _of_block(docs: DataFrame, block: Queries, k: int, scratch: Scratch, *, text: str, id: str) -> DataFrame:
    """query (its digest), rank, id and score for the queries of one block."""
    spark = docs.sparkSession
    context = spark.sparkContext
    vectors = scratch.saved(_vectors(docs, context.broadcast(block.vocabulary), text=text, id=id))
    n_docs, all_terms = vectors.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = _frequencies(vectors, len(block.vocabulary))
    weights = np.array([term_weight(n_docs, int(x)) for x in df], np.int64)
    rows = scratch.saved(_by_length(vectors, n_docs, max(1, all_terms)))
    cut = rows.agg(F.percentile_approx("length", 1 - HEAD, 1000)).first()[0] or 0.0
    is_head = F.col("length") >= cut
    goals = np.zeros(len(block.names), np.int64)
    head = scratch.saved(_searched(rows.filter(is_head), context.broadcast((block, weights, goals)), k))
    reached = _best(head, k).filter(F.col("rank") == k).select("query", "score").toArrow()
    goals[reached["query"].to_numpy()] = reached["score"].to_numpy()
    rest = _searched(rows.filter(~is_head), context.broadcast((block, weights, goals)), k)
    best = scratch.saved(_best(head.unionByName(rest), k))
    names = spark.createDataFrame(pa.table({"query": pa.array(range(len(block.names)), pa.int32()), "digest": block.names}))
    return scratch.saved(best.join(names, "query").select("digest", "rank", "id", "score"))


def ranked(
    docs: DataFrame,
    items: DataFrame,
    k: int = 10,
    *,
    text: str = "text",
    id: str = "doc_id",
    item_text: str = "text",
    item_id: str = "item_id",
) -> DataFrame:
    """The k best documents of each item: its id, rank from 1, the document's id and score.

    Only scores above 0 count, so an item without terms (null, empty, or of signs only), or
    whose terms no document has, gets no row; null texts of documents hold no term. Equal scores
    rank by id, null ids last; rows that repeat an id are documents of their own, and items that
    repeat are answered each. Other columns are not looked at. Empty tables give no rows.
    """
    spark = docs.sparkSession
    scratch, kept = Scratch(spark), Scratch(spark)
    body = F.coalesce(item_text, F.lit(""))
    asked = items.select(F.col(item_id).alias("item"), F.sha2(body, 256).alias("digest"), body.alias("body"))
    try:
        texts = asked.select(F.col("digest").alias("query"), "body").distinct()
        n, entries = _in_blocks(scratch.saved(_entries(texts)))
        answers = []
        for block in range(n):
            table = entries.filter(F.col("block") == block).select("query", "term", "times").toArrow()
            if table.num_rows:
                answers.append(_of_block(docs, Queries.of(table), k, scratch, text=text, id=id))
        found = answers[0] if answers else spark.createDataFrame([], "digest string, rank int, id bigint, score bigint")
        for more in answers[1:]:
            found = found.unionByName(more)
        rows = asked.select("item", "digest").join(found, "digest")
        return kept.saved(
            rows.select(F.col("item").alias(item_id), "rank", F.col("id").alias(id), "score")
        )
    finally:
        scratch.remove()
