"""Sharding by extendible hashing.

The directory is indexed by the leading bits of a record's hash. It starts with one bucket;
only a bucket over the byte limit splits, on its next bit, until every shard fits. Records
are counted once, in cells of as many bits as the total could need; buckets are sums of
cells. A cell still over the limit is counted again on more bits. Rows that repeat both id
and text agree in all bits; where they are over the limit they can be written once and
numbered, and the bits of their numbers follow.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memberlens.llm.scratch import columns, saved

SHARD_BYTES = 1 << 20
#: Bits that are looked at in one pass beyond those the total size calls for.
SPARE_BITS = 4
HASH_BITS = 48


def _bits(key: Column) -> Column:
    """The leading bits of a key's MD5, as text of 0 and 1."""
    number = F.conv(F.substring(F.md5(key), 1, HASH_BITS // 4), 16, 2)
    return F.lpad(number, HASH_BITS, "0")


def record_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint")


def _keyed(docs: DataFrame, text: str, id: str) -> DataFrame:
    """A row's hash covers id and text, so that rows of one id still come apart."""
    body = F.md5(F.coalesce(text, F.lit("")))
    key = F.concat_ws(":", F.coalesce(F.col(id).cast("string"), F.lit("")), body)
    return docs.select(
        F.struct(*columns(docs)).alias("doc"),
        _bits(key).alias("bits"),
        record_bytes(F.col(text)).alias("n_bytes"),
    )


def directory(records: DataFrame, limit: int = SHARD_BYTES) -> DataFrame:
    """prefix, shard_bytes and shard_rows of every shard, for records with ``bits`` and ``n_bytes``.

    A shard over the limit is a single record, or records that agree in all bits.
    """
    total = records.agg(F.sum("n_bytes")).first()[0] or 0
    step = max(1, math.ceil(math.log2(max(1, total / limit)))) + SPARE_BITS
    open_, done, depth = records.select("bits", "n_bytes"), None, 0
    rows = F.sum("n_rows").alias("shard_rows")
    while True:
        deepest = min(HASH_BITS, depth + step)
        cells = open_.groupBy(F.substring("bits", 1, deepest).alias("cell")).agg(
            F.sum("n_bytes").alias("n_bytes"), F.count(F.lit(1)).alias("n_rows")
        )
        every = F.explode(F.sequence(F.lit(depth), F.lit(deepest))).alias("bits")
        buckets = (
            cells.select("cell", "n_bytes", "n_rows", every)
            .groupBy(F.expr("substring(cell, 1, bits)").alias("prefix"))
            .agg(F.sum("n_bytes").alias("shard_bytes"), rows)
        )
        buckets = saved(buckets)
        full = (F.col("shard_bytes") > limit) & (F.length("prefix") < HASH_BITS) & (F.col("shard_rows") > 1)
        split = buckets.filter(full).select(F.col("prefix").alias("parent"))
        parent = F.expr("substring(prefix, 1, length(prefix) - 1)")
        born = buckets.filter(F.length("prefix") == depth).unionByName(
            buckets.filter(F.length("prefix") > depth).join(split, parent == split["parent"], "left_semi")
        )
        shards = born.filter(~full)
        done = shards if done is None else done.unionByName(shards)
        still = split.filter(F.length("parent") == deepest)
        if deepest == HASH_BITS or still.isEmpty():
            return done
        open_ = open_.join(still, F.substring("bits", 1, deepest) == still["parent"], "left_semi")
        depth = deepest


def _repeats_split(records: DataFrame, stuck: DataFrame, limit: int) -> DataFrame:
    """doc, shard, n_bytes and shard_bytes of the rows under the prefixes ``stuck``.

    The n-th row goes by the lowest bits of n, as many as make every shard fit.
    """
    rows = records.join(stuck.select(F.col("prefix").alias("bits")), "bits", "left_semi")
    rows = rows.select("doc", "bits", "n_bytes", F.spark_partition_id().alias("task"))
    schema = T.StructType([*rows.schema, T.StructField("nth", T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Counter()
        for batch in batches:
            nth = []
            for bits in batch.column(1).to_pylist():
                nth.append(seen[bits])
                seen[bits] += 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nth, pa.int64())], names=schema.names)

    # Written once, so that a row keeps its number.
    rows = saved(rows.mapInArrow(count, schema))
    of_task = rows.groupBy("bits", "task").agg(F.count(F.lit(1)).alias("k"), F.max("n_bytes").alias("most"))
    before = F.sum("k").over(Window.partitionBy("bits").orderBy("task")) - F.col("k")
    group = Window.partitionBy("bits")
    fit_in = F.greatest(F.floor(F.lit(limit) / F.max("most").over(group)), F.lit(1))
    needed = F.ceil(F.sum("k").over(group) / fit_in)
    # Binary digits of the last of the numbers 0 to needed - 1.
    digits = F.length(F.bin(F.greatest(needed - 1, F.lit(1))))
    places = saved(of_task.select("bits", "task", before.alias("before"), digits.alias("digits")))
    number = F.lpad(F.bin(F.col("before") + F.col("nth")), 64, "0")
    shard = F.concat("bits", F.expr("right(number, digits)")).alias("shard")
    named = rows.join(places, ["bits", "task"]).withColumn("number", number).select("doc", shard, "n_bytes")
    sizes = saved(named.groupBy("shard").agg(F.sum("n_bytes").alias("shard_bytes")))
    return named.join(sizes, "shard").select("doc", "shard", "n_bytes", "shard_bytes")


def sharded(
    docs: DataFrame,
    *,
    text: str = "text",
    id: str = "doc_id",
    limit: int = SHARD_BYTES,
    split_repeats: bool = False,
) -> DataFrame:
    """One row per document: doc (its columns), shard, n_bytes and shard_bytes.

    ``shard`` is the hash prefix in binary, the empty text if all fits one shard. A null
    text has no bytes; a document over the limit ends alone, in a shard as large as it is;
    rows that repeat id and text share a shard whatever its size or, with ``split_repeats``,
    as long as they fit it: if not, bits of their numbers follow the hash.
    """
    records = _keyed(docs, text, id)
    shards = saved(directory(records, limit))
    over = (F.length("prefix") == HASH_BITS) & (F.col("shard_bytes") > limit) & (F.col("shard_rows") > 1)
    over = over & F.lit(split_repeats)
    stuck = shards.filter(over)
    depths = [r[0] for r in shards.select(F.length("prefix")).distinct().collect()]
    # At most one of a record's prefixes is a shard.
    depth = F.explode(F.array(*(F.lit(d) for d in sorted(depths)))).alias("depth")
    looked_up = records.select("doc", "n_bytes", "bits", depth).select(
        "doc", "n_bytes", F.expr("substring(bits, 1, depth)").alias("prefix")
    )
    found = looked_up.join(shards.filter(~over), "prefix").select(
        "doc", F.col("prefix").alias("shard"), "n_bytes", "shard_bytes"
    )
    return found if stuck.isEmpty() else found.unionByName(_repeats_split(records, stuck, limit))


def write_shards(docs: DataFrame, folder: str, **options) -> None:
    """The documents as Parquet, one folder for each shard."""
    rows = sharded(docs, **{"split_repeats": True} | options).select("doc.*", "shard")
    rows.repartition("shard").write.partitionBy("shard").parquet(folder)
