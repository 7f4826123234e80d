"""Helpers that several operators of this package share."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.sources.staging import drop_read_shuffles, stage  # noqa: F401

SLICE_ROWS = 1024
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id``, ``text`` (null: empty) and the named columns only, whatever else the frame has."""
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names like the wanted ones that no column of the frame has, in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name in taken:
            name += "_"
        taken.add(name)
        out.append(name)
    return out


def hand_back() -> None:
    """Return what a worker has freed to the system; it lives on after its task beside those of other stages."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of the GNU library
        trim(0)


def in_slices(batches: Iterator[pd.DataFrame], key: str | None = None, rows: int = SLICE_ROWS) -> Iterator[pd.DataFrame]:
    """The rows of a task's batches, few at a time, so that what is made of them stays small; at the end freed memory goes back.

    With a ``key`` only the first row of each key in a batch.
    """
    for batch in batches:
        if key is not None:
            batch = batch.drop_duplicates(key)
        for k in range(0, len(batch), rows):
            yield batch.iloc[k : k + rows].copy()  # a view would keep the whole batch
        del batch
    hand_back()


def id_remainder(column: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def held_out(column: str, n: int, remainder: int) -> Column:
    """Whether the row is kept out of training; rows without an id train nothing either."""
    return F.coalesce(id_remainder(column, n) == remainder, F.lit(True))


def words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, as UTF-8: exactly what ``bytes`` methods do."""
    return text.encode("utf-8", "replace").lower().split() if text else []


def components(links: DataFrame) -> DataFrame:
    """Connected components of links (a long, b long): rows (id, component), component the smallest id.

    Alternates large-star and small-star steps, each a grouping and a join, so that no component
    is gathered; every round is staged in the shared folder, which cuts the lineage. Nodes
    without a link to another node are not returned.
    """
    edges = stage(_star(links.where("a <> b"), large=False), "links")
    before = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
        edges = stage(_star(_star(edges, large=True), large=False), "links")
    roots = edges.select(F.col("b").alias("id"), F.col("b").alias("component"))
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).union(roots).distinct()


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Connect each node's larger (or not larger) neighbours with its smallest neighbour; a > b."""
    both = links.select("a", "b")
    if large:
        both = both.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = both.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = both.join(least, "a")
    if large:
        return joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    moved = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


class Forest:
    """Disjoint sets over 0..n-1, for one task."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, i: int) -> int:
        root = i
        while self.parent[root] != root:
            root = self.parent[root]
        while self.parent[i] != root:
            self.parent[i], i = root, self.parent[i]
        return root

    def join(self, i: int, j: int) -> bool:
        """Whether the two were apart."""
        i, j = self.find(i), self.find(j)
        if i == j:
            return False
        self.parent[max(i, j)] = min(i, j)
        return True
