"""Validation and charts of the optional port-throughput table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch import schema as S
from tidewatch.functions.parsing import once, to_number
from tidewatch.functions.text import normalise_text

# The ports of the older fixed-list chart.
FIXED_PORTS = ["上海港", "宁波舟山港", "深圳港", "广州港", "青岛港"]


def clean_throughput(raw: DataFrame) -> DataFrame:
    """Typed rows with a port, plausible month and year and no negative cargo, without duplicates."""
    df = S.canonical_columns(raw)
    S.require_columns(df, S.THROUGHPUT_REQUIRED, "the throughput table")
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    numbers = ["year", "month", "cargo_10kt"] + [c for c in ["container_10kteu"] if c in kinds]
    df = once(
        df,
        {"port": normalise_text(F.col("port")), **{c: to_number(F.col(c), kinds[c]) for c in numbers}},
    )
    keep = F.lit(True)
    for c in ["port", *numbers]:
        keep = keep & F.col(c).isNotNull()
    keep = (
        keep
        & F.col("month").between(1, 12)
        & F.col("year").between(1900, 2100)
        & (F.col("cargo_10kt") >= 0)
    )
    return (
        df.where(keep)
        .dropDuplicates()
        .withColumns({"year": F.col("year").cast("int"), "month": F.col("month").cast("int")})
    )


def throughput_quality(raw: DataFrame, clean: DataFrame | None = None) -> DataFrame:
    clean = clean_throughput(raw) if clean is None else clean
    valid = clean.agg(F.count("*").alias("n")).scalar()
    return raw.agg(F.count("*").alias("raw_rows")).select(
        "raw_rows", valid.alias("valid_rows"), (F.col("raw_rows") - valid).alias("dropped_rows")
    )


def throughput_warnings(quality: DataFrame) -> DataFrame:
    return quality.where(F.col("dropped_rows") > 0).select(
        F.lit(1).alias("position"),
        F.lit("throughput").alias("source"),
        F.lit("invalid_or_duplicate_dropped").alias("warning"),
        F.col("dropped_rows").alias("affected"),
    )


def _total(c: str = "cargo_10kt") -> Column:
    return F.sum(F.col(c).cast("decimal(28,4)")).cast("double")


def top_ports(throughput: DataFrame, top: int = 5) -> DataFrame:
    return (
        throughput.groupBy("port")
        .agg(_total().alias("total_cargo"))
        .orderBy(F.desc("total_cargo"), F.asc("port"))
        .limit(top)
    )


def _of_ports(throughput: DataFrame, top: int, ports: list[str] | None) -> DataFrame:
    if ports is not None:
        return throughput.where(F.col("port").isin(ports))
    # At most ``top`` rows, by the limit.
    return throughput.join(F.broadcast(top_ports(throughput, top)), "port", "left_semi")


def port_annual(throughput: DataFrame, top: int = 5, ports: list[str] | None = None) -> DataFrame:
    """Cargo per year of the leading (or given) ports, also in units of 10,000."""
    return (
        _of_ports(throughput, top, ports)
        .groupBy("port", "year")
        .agg(_total().alias("cargo_10kt"))
        .withColumn("cargo_100mt", F.col("cargo_10kt") / 10000)
    )


def port_seasonality(throughput: DataFrame, top: int = 5, ports: list[str] | None = None) -> DataFrame:
    """Mean cargo by port and month relative to the port's mean; the grid has all twelve months.

    A missing month takes the port's mean, and a port with a mean of 0 divides by 1.
    """
    chosen = _of_ports(throughput, top, ports)
    means = chosen.groupBy("port", "month").agg((_total() / F.count("cargo_10kt")).alias("mean_cargo"))
    grid = means.select("port").distinct().withColumn("month", F.explode(F.sequence(F.lit(1), F.lit(12))))
    # Twelve rows per port.
    year = W.partitionBy("port")
    filled = grid.join(means, ["port", "month"], "left").withColumn(
        "mean_cargo", F.coalesce("mean_cargo", F.avg("mean_cargo").over(year), F.lit(0.0))
    )
    base = F.avg("mean_cargo").over(year)
    return filled.withColumn(
        "relative", F.col("mean_cargo") / F.when(base == 0, F.lit(1.0)).otherwise(base)
    )


def seasonality_wide(seasonality: DataFrame) -> DataFrame:
    return seasonality.groupBy("port").pivot("month", list(range(1, 13))).agg(F.first("relative"))
