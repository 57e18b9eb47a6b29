"""Exact dedup by Grace hash partitioning.

Records are dealt to partitions by a hash of their content. A task adds the records of its
partition to an open-addressing table that compares complete contents. When the table
outgrows its limit, table and remaining records go to spill files by the next bits of the
hash, and each file is treated the same way, until every bucket fits.

Equal contents of one batch are merged before they are shuffled, so a content that a third
of all records share arrives as one record per batch, not per copy.

Spill files are unnamed files of one task, like Spark's own sort spill: a lost executor
loses nothing but the task, which runs again from the shuffle.
"""

from __future__ import annotations

import hashlib
import pickle
import sys
import tempfile
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from memberlens.llm.scratch import columns

#: Bytes of distinct records that one table may hold, as they lie in memory.
TABLE_BYTES = 128 << 20
#: Bytes of a record's fields and its places in the table, besides its content and what it carries.
RECORD_BYTES = 320
#: Hash bits that one level of spill files uses.
FAN_BITS = 4
HASH_BITS = 64

# Places of a record's fields: hash, content, id, number of records merged; then what it carries.
HASH, CONTENT, ID, COUNT = range(4)


@dataclass
class ContentTable:
    """Open addressing with linear probing; of equal contents the largest id stays."""

    slots: array = None
    records: list = None
    held: int = 0

    def __post_init__(self):
        self.slots, self.records = array("q", [-1]) * 1024, []

    def add(self, record: tuple) -> None:
        at = self._find(record)
        if self.slots[at] < 0:
            self.slots[at] = len(self.records)
            self.records.append(record)
            self.held += _weight(record)
            if 2 * len(self.records) > len(self.slots):
                self._grow()
            return
        there = self.records[self.slots[at]]
        best = max(there, record, key=lambda r: (r[ID] is not None, r[ID] or 0))
        merged = there[COUNT] + record[COUNT]
        self.records[self.slots[at]] = (*best[:COUNT], merged, *best[COUNT + 1 :])

    def _find(self, record: tuple) -> int:
        mask = len(self.slots) - 1
        at = record[HASH] & mask
        while (k := self.slots[at]) >= 0:
            there = self.records[k]
            if there[HASH] == record[HASH] and there[CONTENT] == record[CONTENT]:
                break
            at = (at + 1) & mask
        return at

    def _grow(self) -> None:
        self.slots = array("q", [-1]) * (2 * len(self.slots))
        mask = len(self.slots) - 1
        for k, record in enumerate(self.records):
            at = record[HASH] & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = k


def _weight(record: tuple) -> int:
    """The memory that a record takes in the table."""
    carried = record[COUNT + 1] if len(record) > COUNT + 1 else None
    more = sum(sys.getsizeof(v) for v in carried.values()) + sys.getsizeof(carried) if carried else 0
    return RECORD_BYTES + sys.getsizeof(record[CONTENT]) + more


def distinct(records: Iterable[tuple], limit: int, depth: int = 0) -> Iterator[tuple]:
    """One record for each distinct content, with all counts added up."""
    table, rest = ContentTable(), iter(records)
    for record in rest:
        table.add(record)
        if table.held > limit and (depth + 1) * FAN_BITS <= HASH_BITS:
            break
    else:
        yield from table.records
        return
    files = [tempfile.TemporaryFile() for _ in range(1 << FAN_BITS)]  # noqa: SIM115
    shift = HASH_BITS - (depth + 1) * FAN_BITS
    for source in (table.records, rest):
        for record in source:
            bucket = (record[HASH] >> shift) & (len(files) - 1)
            pickle.dump(record, files[bucket], pickle.HIGHEST_PROTOCOL)
        source = None
    del table
    for file in files:
        with file:
            yield from distinct(_reread(file), limit, depth + 1)


def _reread(file) -> Iterator[tuple]:
    file.seek(0)
    while True:
        try:
            yield pickle.load(file)
        except EOFError:
            return


def _records(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _batches(records: Iterable[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    rows, size = [], 0
    for record in records:
        rows.append(record)
        size += 200 + len(record[CONTENT])
        if size > 8 << 20:
            yield _batch(rows, schema)
            rows, size = [], 0
    if rows:
        yield _batch(rows, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    arrays = [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def _digest(record: tuple) -> tuple:
    name = hashlib.sha256(record[CONTENT].encode()).hexdigest()
    return (record[HASH], name, *record[ID:])


def distinct_contents(
    docs: DataFrame,
    *,
    text: str = "text",
    id: str = "doc_id",
    digest_only: bool = False,
    table_bytes: int = TABLE_BYTES,
) -> DataFrame:
    """One row per distinct text: hash, content, keep_id, group_size and carried.

    A null text is an empty one. Of equal texts the largest id stays, a null id only if
    there is no other. ``carried`` is a struct of the columns of the row that stays, but
    for the text, with ``text_is_null``. With ``digest_only``, ``content`` is the SHA-256
    of the text in hexadecimal.
    """
    rows = docs.select(
        F.xxhash64(F.coalesce(text, F.lit(""))).alias("hash"),
        F.coalesce(text, F.lit("")).alias("content"),
        F.col(id).cast("bigint").alias("keep_id"),
        F.lit(1).cast("bigint").alias("group_size"),
        F.struct(F.col(text).isNull().alias("text_is_null"), *columns(docs, text)).alias("carried"),
    )
    if digest_only:
        rows = rows.drop("carried")
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema])
    arrow = to_arrow_schema(schema)

    def merge_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _batches(distinct(_records([batch]), 1 << 62), arrow)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = distinct(_records(batches), table_bytes)
        yield from _batches(map(_digest, found) if digest_only else found, arrow)

    dealt = rows.mapInArrow(merge_batch, schema).repartition("hash")
    return dealt.mapInArrow(settle, schema)


def copy_groups(docs: DataFrame, *, text: str = "text", id: str = "doc_id") -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256.

    Documents with equal texts are a group, a null text counting as empty; the largest id
    is kept. A row that repeats id and text counts in ``group_size`` and gets the same
    answer as its twin; a null id is kept only where the whole group has none.
    """
    classes = distinct_contents(docs, text=text, id=id, digest_only=True).select(
        F.col("content").alias("text_sha256"), "keep_id", "group_size"
    )
    members = docs.select(
        F.col(id).alias("member_id"),
        F.sha2(F.coalesce(text, F.lit("")), 256).alias("text_sha256"),
    )
    return members.join(classes, "text_sha256").select(
        F.col("member_id").alias(id),
        "keep_id",
        "group_size",
        F.col("member_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
    )


def without_copies(docs: DataFrame, *, text: str = "text", id: str = "doc_id") -> DataFrame:
    """The documents with one row of each group of equal texts, all columns as they were."""
    kept = distinct_contents(docs, text=text, id=id)
    text_back = F.when(~F.col("carried.text_is_null"), F.col("content")).alias(text)
    place = {c: F.col("carried").getField(c).alias(c) for c in docs.columns if c != text}
    return kept.select(*(place.get(c, text_back) for c in docs.columns))
