"""Shipment, raw-shipment and port-throughput tables derived from a star schema of sales tables.

Dimension joins carry no hint: Spark broadcasts a dimension only when its size allows, and AQE splits
skewed join partitions otherwise.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.sources.staging import drop_read_shuffles, find_staged, stage

SHIPMENT_TABLES = ["lineitem", "orders", "supplier", "part", "customer", "nation"]
LINE_COLUMNS = [
    "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_shipdate", "l_extendedprice", "l_quantity",
    "o_orderdate", "p_size", "p_type", "carrier", "origin", "dest",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _with_dimensions(spark: SparkSession, sf_dir: str, lines: DataFrame) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_type")
    origin = nation.select(F.col("n_nationkey").alias("origin_key"), F.col("n_name").alias("origin"))
    dest = nation.select(F.col("n_nationkey").alias("dest_key"), F.col("n_name").alias("dest"))
    # Destinations are settled on the narrow orders side, so the wide lines never shuffle by customer.
    orders = (
        table(spark, sf_dir, "orders")
        .select("o_orderkey", "o_custkey", "o_orderdate")
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(dest, F.col("c_nationkey") == F.col("dest_key"))
        .select("o_orderkey", "o_orderdate", "dest")
    )
    return (
        # Both sides grow with the data: always a shuffled join (AQE splits skewed partitions). Size
        # estimates of compressed files would otherwise let Spark broadcast the lines.
        lines.join(orders.hint("merge"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(origin, F.col("s_nationkey") == F.col("origin_key"))
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .withColumnRenamed("s_name", "carrier")
    )


def _delay() -> Column:
    gap = F.datediff("l_shipdate", "o_orderdate")
    return F.greatest(((gap % 200) + 200) % 200 - 175, F.lit(0))


def _plus_days(ts: Column, days: Column) -> Column:
    return ts + F.make_dt_interval(days)


def shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One clean row per order line. Order and line number repeat for different lines, so the id names all of a line."""
    lines = table(spark, sf_dir, "lineitem")
    money = lambda c: F.col(c).cast("decimal(18,2)").cast("string")
    planned, delay = F.col("p_size"), _delay()
    plan_arrival = _plus_days(F.col("o_orderdate"), planned)
    return _with_dimensions(spark, sf_dir, lines).select(
        F.concat_ws(
            "-", "l_orderkey", "l_linenumber", F.date_format("l_shipdate", "yyyyMMdd"), "l_partkey", "l_suppkey",
            money("l_extendedprice"), money("l_quantity"), "l_returnflag",
        ).alias("order_id"),
        "carrier",
        F.col("l_returnflag").alias("mode"),
        F.col("p_type").alias("cargo_type"),
        "origin",
        "dest",
        F.col("o_orderdate").alias("ship_ts"),
        plan_arrival.alias("plan_arrival_ts"),
        _plus_days(F.col("o_orderdate"), planned + delay).alias("actual_arrival_ts"),
        planned.cast("double").alias("planned_days"),
        delay.cast("double").alias("delay_days"),
        F.col("l_quantity").alias("weight_t"),
        F.col("l_extendedprice").alias("freight_usd"),
    )


def input_key(spark: SparkSession, sf_dir: str, names: list[str]) -> str:
    """Digest of path, length and modification time of the input files (no data is read)."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    parts = []
    for name in names:
        path = jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        fs = path.getFileSystem(conf)
        for status in [fs.getFileStatus(path), *fs.listStatus(path)]:
            parts.append(
                f"{status.getPath()}|{status.getLen()}|{status.getModificationTime()}"
            )
    return hashlib.sha256("\n".join(parts).encode()).hexdigest()


def staged_shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``shipments`` as a shared-folder table, for the plans that read it more than once."""
    key = input_key(spark, sf_dir, SHIPMENT_TABLES)
    found = find_staged(spark, "shipments", key)
    return found if found is not None else stage(shipments(spark, sf_dir), "shipments", key)


def staged_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines with their dimensions, not yet text, as a shared-folder table; the shuffles of the joins are gone before others begin."""
    key = input_key(spark, sf_dir, SHIPMENT_TABLES)
    found = find_staged(spark, "lines", key)
    if found is None:
        joined = _with_dimensions(spark, sf_dir, table(spark, sf_dir, "lineitem"))
        found = stage(joined.select(*LINE_COLUMNS), "lines", key)
        drop_read_shuffles(spark)
    return found


def shipments_raw(spark: SparkSession, sf_dir: str, lines: DataFrame | None = None) -> DataFrame:
    """The same lines as dirty text, with duplicates, for the validator. ``lines``: those of ``staged_lines``, if they are to be read.

    ``src_ord`` and ``cp`` give the input order; they are not part of a row's content.
    """
    part_mod = lambda m: (F.col("l_partkey") % m) == 0
    iso, order_date = "yyyy-MM-dd", F.col("o_orderdate")
    planned, delay = F.col("p_size"), _delay()
    line_id = F.concat_ws("-", "l_orderkey", "l_linenumber")
    money = lambda c: F.col(c).cast("decimal(18,2)").cast("string")
    line = F.col("l_linenumber") % 3
    if lines is None:
        lines = _with_dimensions(spark, sf_dir, table(spark, sf_dir, "lineitem"))
    rows = lines.select(
        F.when(part_mod(131), F.lit("nan"))
        .when(part_mod(11), F.concat(F.lit("  "), line_id, F.lit(" ")))
        .otherwise(line_id)
        .alias("order_id"),
        F.when(part_mod(89), F.lit("")).otherwise(F.col("carrier")).alias("carrier"),
        F.col("l_returnflag").alias("mode"),
        "origin",
        "dest",
        F.when(part_mod(101), F.lit("not-a-date"))
        .when(line == 0, F.date_format(order_date, iso))
        .when(line == 1, F.date_format(order_date, "yyyy/MM/dd"))
        .when(F.col("l_linenumber") == 2, F.date_format(order_date, "d MMM yyyy"))
        .when(F.col("l_linenumber") == 5, F.date_format(order_date, "MM/dd/yyyy hh:mm a"))
        .otherwise(F.date_format(order_date, "yyyyMMdd"))
        .alias("ship_ts"),
        F.date_format(_plus_days(order_date, planned), iso).alias("plan_arrival_ts"),
        F.when(F.col("l_suppkey") % 10 == 0, F.date_format("l_shipdate", iso))
        .otherwise(F.date_format(_plus_days(order_date, planned + delay), iso))
        .alias("actual_arrival_ts"),
        F.when(part_mod(103), F.lit("inf"))
        .when(part_mod(107), F.lit("-5"))
        .when(part_mod(109), F.lit("1,234"))
        .otherwise(money("l_quantity"))
        .alias("weight_t"),
        money("l_extendedprice").alias("freight_usd"),
        F.when(part_mod(13), planned + 1).otherwise(planned).cast("string").alias("planned_days"),
        F.when(F.col("l_suppkey") % 7 == 0, delay + 1).otherwise(delay).cast("string").alias("delay_days"),
        F.col("p_type").alias("cargo_type"),
        F.concat_ws(
            "|", F.date_format("l_shipdate", iso), "l_partkey", "l_suppkey",
            money("l_extendedprice"), money("l_quantity"), "l_returnflag",
        ).alias("src_ord"),
        F.when(part_mod(50), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))).alias("copies"),
    )
    return rows.withColumn("cp", F.explode("copies")).drop("copies")


RAW_ORDER = ["src_ord", "cp"]


def port_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cargo per port (supplier nation) and month of shipping."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    # Summed per supplier and month first: the joins then see the rollup, not every line.
    lines = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_suppkey", F.year("l_shipdate").alias("year"), F.month("l_shipdate").alias("month"))
        .agg(F.sum(F.col("l_quantity").cast("decimal(18,2)")).alias("q"))
    )
    return (
        lines.join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .groupBy(F.col("n_name").alias("port"), "year", "month")
        .agg(F.sum("q").cast("double").alias("cargo_10kt"))
    )
