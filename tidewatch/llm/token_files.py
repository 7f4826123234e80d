"""Token-id files: all ids of a corpus one after the other, with Elias-Fano coded document ends.

A file set is a Parquet folder, so that any store Spark writes to holds it and a lost task is simply
written again. Each row is a segment of whole documents: the ids as little-endian integers, as narrow as the vocabulary
allows, the ends of its documents and their numbers, both Elias-Fano coded. Segments are ordered by
(shard, segment); shards are ranges of ascending doc_id.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import tokens
from tidewatch.llm.common import documents, hand_back
from tidewatch.llm.elias_fano import EliasFano

SEGMENT_IDS = 1_000_000  # a segment ends after the document that reaches this

_FANO = "{0}_low_bits int, {0}_low binary, {0}_high binary, {0}_select binary"
SEGMENT = (
    "shard int, segment int, start long, n_docs int, n_ids long, width int, ids binary, nameless int, first_doc long, "
    + _FANO.format("end") + ", " + _FANO.format("doc")
)


def _coded(name: str, values: np.ndarray) -> dict:
    f = EliasFano.of(values)
    return {f"{name}_low_bits": f.low_bits, f"{name}_low": f.low, f"{name}_high": f.high, f"{name}_select": f.samples}


def fano(row: dict, name: str, n: int) -> EliasFano:
    return EliasFano(n, int(row[f"{name}_low_bits"]), row[f"{name}_low"], row[f"{name}_high"], row[f"{name}_select"])


def _segment(shard: int, k: int, start: int, ids: list[np.ndarray], docs: list, width: int) -> dict:
    named = [int(d) for d in docs if d is not None]
    first = named[0] if named else 0
    ends = np.cumsum([len(x) for x in ids])
    row = {
        "shard": shard, "segment": k, "start": start, "n_docs": len(docs), "n_ids": int(ends[-1]), "width": width,
        "ids": np.concatenate(ids).astype(f"<u{width}").tobytes(), "nameless": len(docs) - len(named), "first_doc": first,
    }
    return row | _coded("end", ends) | _coded("doc", np.array([d - first for d in named], np.uint64))


def write_token_files(docs: DataFrame, path: str, vocabulary: str, end_id: int) -> None:
    """Encode whole texts (null: empty), append ``end_id`` to each, and write them in ascending doc_id order.

    Documents without an id come first; repeated ids stay next to each other, ordered by text.
    An empty table gives an empty file set.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, shard, k, start = tokens.encoder(vocabulary), TaskContext.get().partitionId(), 0, 0
        width = 2 if max(enc.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        ids, names, size = [], [], 0
        for batch in batches:
            for doc, text in zip(batch["doc_id"].astype(object), batch["text"]):
                ids.append(np.append(enc.encode([text])[0], np.uint32(end_id)))
                names.append(None if pd.isna(doc) else int(doc))
                size += len(ids[-1])
                if size >= SEGMENT_IDS:
                    yield pd.DataFrame([_segment(shard, k, start, ids, names, width)])
                    k, start, ids, names, size = k + 1, start + size, [], [], 0
        if ids:
            yield pd.DataFrame([_segment(shard, k, start, ids, names, width)])
        enc.forget()
        hand_back()

    ordered = documents(docs).repartitionByRange(F.col("doc_id").asc()).sortWithinPartitions("doc_id", "text")
    ordered.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(write, SEGMENT).write.option(
        "compression", "zstd"
    ).parquet(path)


def segments(spark: SparkSession, path: str) -> DataFrame:
    """The segments with ``before``, the number of ids of all earlier segments (one row a shard meets the driver)."""
    rows = spark.read.schema(SEGMENT).parquet(path)
    totals = rows.groupBy("shard").agg(F.sum("n_ids").alias("n")).orderBy("shard").collect()
    before = np.concatenate([[0], np.cumsum([r["n"] for r in totals])])
    shards = spark.createDataFrame([(r["shard"], int(b)) for r, b in zip(totals, before)], "shard int, base long")
    return rows.join(F.broadcast(shards), "shard").withColumn("before", F.col("base") + F.col("start")).drop("base")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) per document, all from the files."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                n, nameless = row["n_docs"], row["nameless"]
                ends = fano(row, "end", n).all()
                docs = fano(row, "doc", n - nameless).all() + row["first_doc"]
                starts = np.concatenate([[0], ends[:-1]])
                ids = np.frombuffer(row["ids"], f"<u{row['width']}").astype("<u4")
                yield pd.DataFrame({
                    "doc_id": pd.array([None] * nameless + docs.tolist(), "Int64"),
                    "start": starts + row["before"],
                    "n_tokens": ends - starts,
                    "ids_crc32": [zlib.crc32(ids[a:b]) for a, b in zip(starts, ends)],
                })

    return segments(spark, path).mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def ids_of(row: dict, i: int) -> np.ndarray:
    """The ids of the i-th document of a segment, by two selects."""
    ends = fano(row, "end", row["n_docs"])
    ids = np.frombuffer(row["ids"], f"<u{row['width']}")
    return ids[ends[i - 1] if i else 0 : ends[i]]
