"""Rules, route z-score and verdict on a stream, against statistics of a batch.

The statistics (mode floors and route sums) are tables in versioned folders. A stream joins them as static tables, so it keeps no state
and each row gets the verdict that the batch plan would give it. ``judge_batches`` looks for the newest version before every micro-batch.
The forest needs the whole table and stays in the batch plans.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter

from tidewatch.config import DetectorConfig
from tidewatch.errors import DataValidationError
from tidewatch.operators.ensemble import with_verdict
from tidewatch.operators.features import preprocess
from tidewatch.operators.iforest import skipped_columns
from tidewatch.operators.rules import mode_floors, with_rules
from tidewatch.operators.zscore import route_sums, with_zscore


@dataclass(frozen=True)
class Statistics:
    version: int
    floors: DataFrame
    sums: DataFrame


def _versions(spark: SparkSession, folder: str) -> list[int]:
    """Versions whose last table is complete."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    numbers = sorted(int(n.removeprefix("version=")) for n in names if n.startswith("version=") and n[8:].isdigit())
    done = lambda n: fs.exists(jvm.org.apache.hadoop.fs.Path(f"{folder}/version={n}/sums/_SUCCESS"))
    return [n for n in numbers if done(n)]


def save_statistics(orders: DataFrame, folder: str) -> int:
    """Write the statistics of a validated table as the next version; returns its number. Earlier versions stay."""
    base = preprocess(orders)
    version = max(_versions(orders.sparkSession, folder), default=0) + 1
    mode_floors(base).write.parquet(f"{folder}/version={version}/floors")
    route_sums(base).write.parquet(f"{folder}/version={version}/sums")
    return version


def load_statistics(spark: SparkSession, folder: str, version: int | None = None) -> Statistics:
    """The newest version, or the one that is named."""
    known = _versions(spark, folder)
    if not known or version is not None and version not in known:
        raise DataValidationError(f"no statistics of that version in {folder}")
    version = known[-1] if version is None else version
    read = lambda name: spark.read.parquet(f"{folder}/version={version}/{name}")
    return Statistics(version, read("floors"), read("sums"))


def judge(orders: DataFrame, statistics: Statistics, config: DetectorConfig | None = None, included: bool = True) -> DataFrame:
    """Verdicts of validated orders, in a batch or a stream alike.

    ``included`` says that the statistics were taken over these orders, so each takes itself out of its route's sums. New orders
    (``included=False``) are measured against all of their route; those of a route without statistics are not judged by it.
    """
    config = config or DetectorConfig()
    base = preprocess(orders).withColumns(skipped_columns())
    df = with_zscore(with_rules(base, statistics.floors), config, statistics.sums, included)
    return with_verdict(df, config.zscore_threshold, forest=False)


def judge_batches(
    orders: DataFrame, folder: str, write: Callable[[DataFrame, int], None], config: DetectorConfig | None = None, included: bool = False
) -> DataStreamWriter:
    """A stream writer that hands each micro-batch, judged by the newest statistics, to ``write`` with its number."""

    def each(batch: DataFrame, number: int) -> None:
        write(judge(batch, load_statistics(batch.sparkSession, folder), config, included), number)

    return orders.writeStream.foreachBatch(each)
