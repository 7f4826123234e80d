"""A corpus pipeline of four stages: quality classifier, line dedup, near-duplicate join, packing.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last
return the columns of documents; ``n_chars`` follows the text.

In every stage null texts count as empty ones and are not rejected for it, rows without a doc_id are never taken for copies by their id,
very long texts are worked through whole, an empty table gives an empty one, and columns beyond those of documents
pass through whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import line_dedup, packing, quality, shingle_join
from tidewatch.llm.common import held_out
from tidewatch.llm.queries import BYTE_BPE
from tidewatch.sources.staging import stage


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model takes for good; it learns from the labelled rows that op7 learns from."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit(docs, labels, ~held_out("doc_id", 4, 2))
    if model is None:  # nothing was learnt, so nothing is rejected
        return docs
    return quality.accepted(docs, model)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of lines go, and documents that held nothing else."""
    kept = line_dedup.drop_repeated_lines(docs)
    return kept.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose sets of five-word shingles have a similarity of 0.8 or more."""
    return shingle_join.drop_near_duplicates(docs, n=5, percent=80)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 1024 tokens."""
    return packing.pack_documents(docs, BYTE_BPE, end_id=0)


STAGES = [
    ("quality classifier", classify),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", dedup_documents),
    ("packing", pack),
]

ORACLE_SQL = None  # no SQL expresses the classifier or the vocabulary; tests/llm compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
