"""Mixing sources to target weights by systematic sampling.

A source's expected copies of a document are its target over its size, the same for all its
documents. Their running sum, plus one random offset for the source, crosses whole numbers;
each crossing emits the document once. Documents are walked in order of size, so what is
taken comes close to the target.

A running sum over a source that holds a third of all rows is no task for one worker: rows
fall into cells of (source, size class, hash prefix), a cell sums its own rows, and starts
where the sums of the cells before it end.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memberlens.llm.scratch import columns, saved

WORD = "[^\\x20\\x09-\\x0D]+"


@dataclass(frozen=True)
class Mix:
    """``weights`` repeat over the sources in code point order, null last; ``share`` is what
    the mix takes of all sizes, ``most`` what it takes at most of a source, in its size."""

    weights: tuple[int, ...] = (5, 2, 1)
    share: float = 1.5
    most: int = 2
    seed: str = "mix"
    #: Hash digits (hexadecimal) that tell the cells of one source and size class apart.
    digits: int = 3


#: Copies are counted in these parts, as whole numbers: sums then do not depend on their order.
PARTS = 10**9


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def size_class(size: Column) -> Column:
    """Sizes that agree in their first four binary digits share a class."""
    drop = F.greatest(F.length(F.bin(size)) - 4, F.lit(0))
    return drop * 16 + F.call_function("shiftright", size, drop)


def _by_source(source: Column) -> Column:
    """A text in the order of sources, null last, that is never null."""
    return F.coalesce(F.concat(F.lit("0"), source.cast("string")), F.lit("1"))


def targets(sizes: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """mix_source and source_size, with target: what the mix takes of it.

    A target beyond ``most`` times the source's size is cut, and the rest shared by weight
    among the others, until none is above. Only a total and a count pass the driver.
    """
    ranked = _ranked(sizes, "mix_source")
    weights = F.array(*(F.lit(w).cast("double") for w in mix.weights))
    at = F.pmod("place", F.lit(len(mix.weights))).cast("int") + 1
    left = ranked.withColumn("weight", F.element_at(weights, at))
    total = left.agg(F.sum("source_size")).first()[0] or 0
    cap = F.col("source_size") * float(mix.most)
    level, capped = None, F.lit(False)
    while True:
        room, weight, n = left.agg(
            F.sum(F.when(capped, cap).otherwise(0.0)),
            F.sum(F.when(~capped, F.col("weight")).otherwise(0.0)),
            F.count(F.when(capped, 1)),
        ).first()
        if level is not None and n == cut:
            break
        cut = n
        level = (mix.share * total - (room or 0.0)) / weight if weight else 0.0
        capped = capped | (F.col("weight") * level > cap)
        left = left.withColumn("capped", capped)
        capped = F.col("capped")
    target = F.when(capped, cap).otherwise(F.col("weight") * level)
    return left.select("mix_source", "source_size", target.alias("target"))


def _ranked(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` with ``place``, their number in the order of ``key``, from 0."""
    parts = saved(rows.repartitionByRange(key).sortWithinPartitions(key)).select(
        "*", F.spark_partition_id().alias("part")
    )
    counts = {r["part"]: r["count"] for r in parts.groupBy("part").count().collect()}
    starts, before = [], 0
    for part in range(max(counts, default=-1) + 1):
        starts.append(before)
        before += counts.get(part, 0)
    first = F.array(*(F.lit(s).cast("bigint") for s in starts or [0]))
    inside = Window.partitionBy("part").orderBy(key)
    place = F.row_number().over(inside) - 1 + F.element_at(first, F.col("part") + 1)
    return parts.withColumn("place", place).drop("part")


def mixed(
    docs: DataFrame,
    mix: Mix = Mix(),
    *,
    text: str = "text",
    source: str = "source",
    id: str = "doc_id",
    carry: bool = False,
) -> DataFrame:
    """One row per document: doc (its columns), size, source_size, target, copies.

    ``size`` is the number of words, 0 for a null text. A null source is a source. Rows that
    repeat an id, or have none, are walked in the order of their texts' hashes. An empty table gives an empty result.
    """
    kept = columns(docs) if carry else [F.col(id)]
    rows = docs.select(
        F.struct(*kept).alias("doc"),
        _by_source(F.col(source)).alias("mix_source"),
        n_words(F.col(text)).alias("size"),
        # Rows without an id, or of one id, spread by their texts.
        F.md5(F.concat_ws(":", F.lit(mix.seed), F.col(id).cast("string"), F.md5(text))).alias("draw"),
    )
    cell = ["mix_source", "class", "cell"]
    rows = rows.withColumn("class", size_class(F.col("size"))).withColumn(
        "cell", F.substring("draw", 1, mix.digits)
    )
    cells = rows.groupBy(*cell).agg(
        F.count(F.lit(1)).alias("n"), F.sum("size").alias("words")
    )
    cells = saved(cells.withColumn("block", F.substring("cell", 1, 1)))
    wanted = targets(cells.groupBy("mix_source").agg(F.sum("words").alias("source_size")), mix)
    # Three short running sums, each over the totals of the one before.
    levels = ["mix_source", "class", "block", "cell"]
    starts = cells
    for depth in (3, 2, 1):
        totals = cells.groupBy(*levels[: depth + 1]).agg(F.sum("n").alias("n"))
        earlier = Window.partitionBy(*levels[:depth]).orderBy(levels[depth])
        earlier = earlier.rowsBetween(Window.unboundedPreceding, -1)
        start = F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias(f"before_{depth}")
        starts = starts.join(totals.select(*levels[: depth + 1], start), levels[: depth + 1])
    starts = starts.join(wanted, "mix_source").select(
        *cell,
        (F.col("before_1") + F.col("before_2") + F.col("before_3")).alias("start"),
        "source_size",
        "target",
    )
    inside = Window.partitionBy(*cell).orderBy("draw")
    offset = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(mix.seed), "mix_source")), 1, 7), 16, 10)
    unit = F.floor(F.col("target") / F.col("source_size") * PARTS).cast("decimal(38,0)")
    shift = F.floor(offset.cast("double") / float(16**7) * PARTS).cast("decimal(38,0)")

    def crossed(nth: Column) -> Column:
        return F.floor((unit * nth + shift) / F.lit(PARTS).cast("decimal(10,0)")).cast("bigint")

    nth = F.col("start") + F.row_number().over(inside)
    placed = rows.join(starts, cell).withColumn("nth", nth.cast("decimal(18,0)"))
    copies = crossed(F.col("nth")) - crossed(F.col("nth") - F.lit(1).cast("decimal(18,0)"))
    return placed.select(
        "doc",
        "size",
        "source_size",
        "target",
        F.when(F.col("source_size") > 0, copies).otherwise(0).cast("bigint").alias("copies"),
    )


def emitted(docs: DataFrame, mix: Mix = Mix(), **names: str) -> DataFrame:
    """The mix itself: every document as often as it is taken, with its own columns."""
    rows = mixed(docs, mix, carry=True, **names).filter("copies > 0")
    return rows.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("doc.*")
