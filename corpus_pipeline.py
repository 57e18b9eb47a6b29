"""From raw documents to token ids: language, copies, near copies, mix, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return
the columns of documents. What a stage returns is written before the next one reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memberlens.llm import bpe, grace_dedup, jaccard, language, mixing
from memberlens.llm.queries import tokenizer_file
from memberlens.llm.scratch import Scratch


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts the language found into ``lang``; drops null texts and texts without a letter."""
    return language.with_language(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the largest doc_id stays."""
    return grace_dedup.without_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that near-duplicate links join, the smallest doc_id stays."""
    return jaccard.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document comes as often as the mix takes it."""
    return mixing.emitted(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' columns but for the text, with n_tokens and ids."""
    rows = bpe.encoded(docs, tokenizer_file())
    return rows.select("doc.*", F.size("ids").cast("bigint").alias("n_tokens"), "ids")


STAGES = [
    ("language_id", keep_languages),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mix", mix_sources),
    ("encode", encode),
]

#: The language classifier and the tokenizer have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each one's result written to the shared folder.

    What a stage returned is deleted when the next one is written; the last that is written stays.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for _, stage in STAGES[:-1]:
        written = Scratch(spark)
        docs = written.saved(stage(spark, docs, sf_dir))
        if before:
            before.remove()
        before = written
    return STAGES[-1][1](spark, docs, sf_dir)
