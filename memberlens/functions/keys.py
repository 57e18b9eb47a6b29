"""Join keys: ids arrive as text in some tables and as numbers in others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPREAD = "_spread"


def text_key(column: str) -> Column:
    return F.col(column).cast("string")


def int_key(column: str) -> Column:
    """The id as a 64-bit number; NULL (joins nothing) where the text is no number."""
    return F.col(column).try_cast("bigint")


def int_text_key(column: str) -> Column:
    """The id as canonical digits, so that ``007`` and ``7`` meet."""
    return int_key(column).cast("string")


def digits_only(column: str) -> Column:
    """Whole-string digit check; ``$`` would also accept a trailing line feed."""
    return F.col(column).rlike(r"\A[0-9]+\z")


def spread_nulls(df: DataFrame, key: Column, by: list[str]) -> DataFrame:
    """Add the left-hand key of an outer lookup, with NULL keys spread out.

    NULL never matches, yet a plain outer join sends every NULL row to one task.
    Here such rows get a value of their own, from the hash of ``by``, that no right-hand
    key can equal: matching keys start with ``=``, the others with ``?``.
    """
    own_value = F.concat(F.lit("?"), F.xxhash64(*by).cast("string"))
    matching = F.concat(F.lit("="), key.cast("string"))
    return df.withColumn(SPREAD, F.coalesce(matching, own_value))


def keyed(df: DataFrame, key: Column, *columns: str | Column) -> DataFrame:
    """The right-hand side of a lookup against :func:`spread_nulls`.

    Rows without a key match nothing and are left out. A side grouped by this key is
    placed for the lookup already, which saves a shuffle; but adaptive execution splits
    a hot key only if both sides come straight from a shuffle, so where the left-hand
    rows per key are not bounded, group by the plain id first and key the result.
    """
    matching = F.concat(F.lit("="), key.cast("string"))
    return df.filter(key.isNotNull()).select(matching.alias(SPREAD), *columns)


def lookup(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left join on the spread key; several lookups in a row share one partitioning."""
    return left.join(right, SPREAD, "left")
