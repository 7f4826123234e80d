"""The registered queries of this package: each operator over its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import class_ngrams, line_dedup, mixing, packing, quality, rank_bpe, shingle_join, spelling, token_files, turn_repair, url_filter, vector_dedup, weighted_sampling
from tidewatch.llm.common import documents, held_out, table
from tidewatch.sources.staging import scratch

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
URL_RULES = [
    ("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"),
]
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def op1_url_filter(spark: SparkSession, d: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, d, "pages"), URL_RULES)


def op2_class_ngrams(spark: SparkSession, d: str) -> DataFrame:
    return class_ngrams.score_documents(table(spark, d, "documents"), held_out("doc_id", 5, 1))


def op3_token_files(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "token-files")
    token_files.write_token_files(table(spark, d, "documents"), path, BYTE_BPE, end_id=2)
    return token_files.read_documents(spark, path)


def op4_line_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Per document what is left of it; documents of which nothing is left stay as rows here."""
    marked = line_dedup.mark_repeats(table(spark, d, "documents"))
    return marked.select("doc_id", "lines_removed", "nothing_left", F.sha2("text", 256).alias("text_sha256"))


def op5_byte_bpe(spark: SparkSession, d: str) -> DataFrame:
    return rank_bpe.encode_documents(table(spark, d, "documents"), RANKS, public_tokenizers.PATTERN)


def op6_weighted_sampling(spark: SparkSession, d: str) -> DataFrame:
    return weighted_sampling.fingerprints(table(spark, d, "documents"))


def op7_quality(spark: SparkSession, d: str) -> DataFrame:
    docs, kept_out = documents(table(spark, d, "documents")), held_out("doc_id", 4, 2)
    model = quality.fit(docs, table(spark, d, "labels"), ~kept_out)
    scored = docs.select("doc_id", kept_out.alias("held_out"), quality.score(model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= quality.THRESHOLD).cast("int"))


def op9_near_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return shingle_join.near_duplicates(table(spark, d, "documents"), n=4, percent=85)


def op8_pack(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(table(spark, d, "documents"), BYTE_BPE, end_id=0)


def op10_vector_dedup(spark: SparkSession, d: str) -> DataFrame:
    return vector_dedup.near_duplicate_vectors(table(spark, d, "embeddings"))


def op11_turn_repair(spark: SparkSession, d: str) -> DataFrame:
    return turn_repair.repair_damaged(table(spark, d, "conversations"))


def op12_mixing(spark: SparkSession, d: str) -> DataFrame:
    return mixing.taken_words(table(spark, d, "documents"), [5, 2, 1])


def op13_spelling(spark: SparkSession, d: str) -> DataFrame:
    return spelling.variants(table(spark, d, "documents"))


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filter": url_filter.oracle(URL_RULES), "op13_spelling": spelling.ORACLE_SQL}
