"""Session defaults. On a cluster the submitter's settings win; these only fill gaps."""

from __future__ import annotations

from pyspark.sql import SparkSession

# AQE sizes shuffle partitions, splits skewed join partitions and picks join strategies
# from measured sizes; nothing here depends on the number of rows.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "20000",
    "spark.sql.legacy.javaCharsets": "true",  # GB18030 files
}


def get_session(master: str | None = None, app: str = "tidewatch", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
