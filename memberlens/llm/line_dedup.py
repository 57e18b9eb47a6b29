"""Line dedup over range-partitioned line hashes, with built-in expressions only.

Hashes of lines are range-partitioned with a secondary sort by document and position. The
first occurrence of a line in each document is streamed off; what follows needs a line once
per document. Documents that lose lines get a bitmap: 64 lines to a word, words without a
dropped line left out. No text moves before the bitmaps meet it.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memberlens.llm.scratch import saved

SPACE = " \t\n\x0b\x0c\r"
MIN_CHARS = 40
MIN_DOCS = 5


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all else as it is; translate() goes letter by letter and is slow."""
    spelt_out = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.when(F.char_length(text) == F.octet_length(text), F.lower(text)).otherwise(spelt_out)


def _keyed(docs: DataFrame, text: str, id: str) -> DataFrame:
    """The document's id, a fingerprint to tell rows of one id apart, and its text."""
    return docs.select(
        F.col(id).alias("line_doc"),
        F.xxhash64(F.coalesce(text, F.lit(""))).alias("print"),
        F.coalesce(text, F.lit("")).alias("whole"),
    )


def _lines(whole: Column) -> Column:
    return F.split(whole, "\n", -1)


def keep_bitmaps(
    docs: DataFrame,
    *,
    text: str = "text",
    id: str = "doc_id",
    min_chars: int = MIN_CHARS,
    min_docs: int = MIN_DOCS,
) -> DataFrame:
    """line_doc, print and dropped, a map from word number to the bits of dropped lines.

    Only documents that lose a line have a row. A key of at least ``min_chars`` code points
    in at least ``min_docs`` documents stays in the largest id that holds it and goes
    elsewhere; a null id is less than any other.
    """
    line = F.btrim(F.col("line"), F.lit(SPACE))
    lines = (
        _keyed(docs, text, id)
        .select("line_doc", "print", F.posexplode(_lines(F.col("whole"))).alias("pos", "line"))
        .filter(F.char_length(line) >= min_chars)
        .select(F.unhex(F.md5(lower_ascii(line))).alias("hash"), "line_doc", "print", "pos")
    )
    dealt = lines.repartitionByRange(F.col("hash"), F.col("line_doc").desc(), F.col("print"))
    in_document = Window.partitionBy("hash", "line_doc", "print").orderBy("pos")
    firsts = dealt.withColumn("nth", F.row_number().over(in_document)).filter("nth = 1")
    common = (
        firsts.groupBy("hash")
        .agg(F.count(F.lit(1)).alias("docs"), F.max("line_doc").alias("stays_in"))
        .filter(F.col("docs") >= min_docs)
        .select("hash", "stays_in")
    )
    # Both sides then come straight from a shuffle, and a line of very many documents is split.
    common = saved(common)
    dropped = lines.join(common, "hash").filter(~F.col("line_doc").eqNullSafe(F.col("stays_in")))
    bit = F.expr("shiftleft(1L, cast(pos % 64 as int))")
    words = dropped.groupBy("line_doc", "print", F.expr("cast(pos div 64 as int)").alias("word")).agg(
        F.bit_or(bit).alias("bits")
    )
    return words.groupBy("line_doc", "print").agg(
        F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("dropped")
    )


def without_common_lines(docs: DataFrame, **options) -> DataFrame:
    """One row per document: id, n_lines, n_dropped and the text that stays.

    A null or empty text is one empty line. Every row is a document; a row that repeats id
    and text counts once.
    """
    text, id = options.get("text", "text"), options.get("id", "doc_id")
    bitmaps = keep_bitmaps(docs, **options).select(
        F.col("line_doc").alias("map_doc"), F.col("print").alias("map_print"), "dropped"
    )
    rows = _keyed(docs, text, id)
    same = rows["line_doc"].eqNullSafe(bitmaps["map_doc"]) & (rows["print"] == bitmaps["map_print"])
    lines = _lines(F.col("whole"))

    def stays(_: Column, at: Column) -> Column:
        word = F.coalesce(F.element_at("dropped", (at / 64).cast("int")), F.lit(0).cast("bigint"))
        return F.call_function("shiftright", word, at % 64).bitwiseAND(F.lit(1)) == 0

    kept = F.filter(lines, stays)
    return (
        rows.join(bitmaps, same, "left")
        .select(
            F.col("line_doc").alias(id),
            F.size(lines).cast("bigint").alias("n_lines"),
            F.when(F.col("dropped").isNull(), F.col("whole"))
            .otherwise(F.array_join(kept, "\n"))
            .alias("kept_text"),
            F.when(F.col("dropped").isNull(), F.lit(0))
            .otherwise(F.aggregate(
                F.map_values("dropped"), F.lit(0), lambda n, w: n + F.bit_count(w)
            ))
            .cast("bigint")
            .alias("n_dropped"),
        )
        .select(id, "n_lines", "n_dropped", "kept_text")
    )
