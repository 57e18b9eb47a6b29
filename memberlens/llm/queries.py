"""The operators as queries over the test tables, with their SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memberlens.llm import bpe, collocations, grace_dedup, jaccard, language, lexical, line_dedup
from memberlens.llm import mixing, repeats, rotated_codes, sharding, url_model, warc
from memberlens.llm.scratch import Scratch

#: (verdict, host and beginning of the path) of the URL filter's rules.
URL_RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet").select(*columns)


def op1_extendible_sharding(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents", "doc_id", "text")
    rows = sharding.sharded(docs, split_repeats=True)
    return rows.select("doc.doc_id", "shard", "n_bytes", "shard_bytes")


def op2_grace_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return grace_dedup.copy_groups(_table(spark, folder, "documents", "doc_id", "text"))


def op3_rotated_codes(spark: SparkSession, folder: str) -> DataFrame:
    vectors = _table(spark, folder, "embeddings", "vec_id", "embedding")
    return rotated_codes.nearest(vectors, F.pmod("vec_id", F.lit(100)) == 0)


def op4_string_kernel(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents", "doc_id", "text", "lang")
    found = language.identified(docs.select("doc_id", "text"), labelled=docs)
    return found.select("doc.doc_id", "held_out", "lang_pred", "score")


def op5_sparse_product(spark: SparkSession, folder: str) -> DataFrame:
    rows = jaccard.grouped(_table(spark, folder, "documents", "doc_id", "text"))
    return rows.select("doc_id", "n_shingles", "component_id")


def op6_block_anchors(spark: SparkSession, folder: str) -> DataFrame:
    rows = repeats.without_repeats(_table(spark, folder, "documents", "doc_id", "text"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op7_url_model(spark: SparkSession, folder: str) -> DataFrame:
    return url_model.judged(_table(spark, folder, "pages", "page_id", "url"), URL_RULES)


def op8_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    rows = line_dedup.without_common_lines(_table(spark, folder, "documents", "doc_id", "text"))
    digest = F.sha2("kept_text", 256).alias("kept_sha256")
    return rows.select("doc_id", "n_lines", "n_dropped", digest)


def op9_systematic_mix(spark: SparkSession, folder: str) -> DataFrame:
    rows = mixing.mixed(_table(spark, folder, "documents", "doc_id", "text", "source"))
    taken = (F.col("size") * F.col("copies")).alias("taken")
    return rows.select("doc.doc_id", "size", "source_size", "target", taken)


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op10_backtracking_bpe(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents", "doc_id", "text")
    found = bpe.digests(docs, tokenizer_file())
    return found.select("doc.doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op11_norm_buckets(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents", "doc_id", "text")
    return lexical.ranked(docs, _table(spark, folder, "benchmark", "item_id", "text"))


def op12_suffix_subtrees(spark: SparkSession, folder: str) -> DataFrame:
    rows = collocations.mined(_table(spark, folder, "documents", "lang", "text"))
    return rows.withColumn("rank", F.col("rank").cast("bigint"))


def op13_chunked_warc(spark: SparkSession, folder: str) -> DataFrame:
    pages = _table(spark, folder, "pages", "page_id", "url", "html")
    archives = Scratch(spark)
    try:
        warc.write(pages, archives.folder, id="page_id", url="url", payload="html")
        return warc.listed(spark, archives.folder).select(
            F.col("source").cast("bigint").alias("page_id"),
            F.col("size").alias("payload_bytes"),
            F.col("digest").alias("payload_digest"),
            F.col("kind").alias("record_type"),
            F.col("refers_source").cast("bigint").alias("refers_to"),
        )
    finally:
        archives.remove()


QUERIES: dict[str, Query] = {
    q.__name__: q
    for q in (
        op1_extendible_sharding,
        op2_grace_dedup,
        op3_rotated_codes,
        op4_string_kernel,
        op5_sparse_product,
        op6_block_anchors,
        op7_url_model,
        op8_line_dedup,
        op9_systematic_mix,
        op10_backtracking_bpe,
        op11_norm_buckets,
        op12_suffix_subtrees,
        op13_chunked_warc,
    )
}
