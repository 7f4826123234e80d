"""The detection plan: preprocess, three layers as columns of one frame, verdict."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch import schema as S
from tidewatch.config import DetectorConfig
from tidewatch.errors import DataValidationError
from tidewatch.operators.dedup import require_unique
from tidewatch.operators.ensemble import with_verdict
from tidewatch.operators.features import preprocess
from tidewatch.operators.iforest import skipped_columns, with_forest
from tidewatch.operators.rules import mode_floors, with_rules
from tidewatch.operators.zscore import route_sums, with_zscore
from tidewatch.sources.csv_files import POSITION, read_csv
from tidewatch.sources.staging import measured, stage


def load_orders(source: DataFrame | str) -> DataFrame:
    """A frame, or a path to Parquet or CSV."""
    if isinstance(source, DataFrame):
        return source
    spark = SparkSession.active()
    if source.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(source)
    return read_csv(spark, source).rows.drop(*POSITION)


def check_input(base: DataFrame, unique: bool) -> int:
    """Row count, after refusing an empty table, null features or repeated ids."""
    null = F.greatest(*[F.col(c).isNull() for c in S.DETECTOR_NUMERIC])
    facts = base.agg(F.count("*").alias("n"), F.count_if(null).alias("nulls")).first()
    if facts["n"] == 0:
        raise DataValidationError("the detector cannot analyse an empty table")
    if facts["nulls"]:
        raise DataValidationError("the detector got missing or non-numeric features; validate the table first")
    if unique:
        require_unique(base, "order_id", "the detector input")
    return facts["n"]


def run_layers(
    base: DataFrame, config: DetectorConfig, rows: int | None = None, forest: bool = True
) -> DataFrame:
    """All layers and the verdict on a preprocessed frame that is cheap to read repeatedly."""
    floors, sums = measured(mode_floors(base)), measured(route_sums(base))
    # The statistics come from the base; the forest's scan is the one the other layers extend.
    df = with_forest(base, config, rows) if forest else base.withColumns(skipped_columns())
    df = with_zscore(with_rules(df, floors), config, sums)
    return with_verdict(df, config.zscore_threshold, forest)


def detect(
    orders: DataFrame | str,
    config: DetectorConfig | None = None,
    *,
    zscore_threshold: float | None = None,
    iforest_contamination: float | None = None,
    forest: bool = True,
    staged: bool = False,
    unique: bool = True,
) -> DataFrame:
    """Detect anomalies in a validated order table (a frame or a path).

    ``staged`` says that the input is already cheap to re-read (a plain table scan); otherwise it is
    staged once. ``unique=False`` skips the key check, a full shuffle, for validated input.
    """
    config = config or DetectorConfig()
    config = replace(
        config,
        zscore_threshold=config.zscore_threshold if zscore_threshold is None else zscore_threshold,
        iforest_contamination=(
            config.iforest_contamination if iforest_contamination is None else iforest_contamination
        ),
    )
    base = preprocess(load_orders(orders))
    if not staged:
        base = stage(base, "base")
    rows = check_input(base, unique)
    return run_layers(base, config, rows, forest)
