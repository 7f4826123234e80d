"""Intermediate tables in the shared folder of the cluster.

A frame that several passes read (detection reads its input three to five times) is written
once as Parquet: later passes prune columns and skip the joins and shuffles that built it, and a
lost executor costs a re-read, not a re-computation. The folder is the one the cluster names in
``spark.checkpoint.dir``; a folder of our own is only made for a local master.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_staged: dict[tuple[str, str], str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; also makes it the checkpoint folder of the context."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if path:
        if not current:
            sc.setCheckpointDir(path)
        return path.rstrip("/")
    local = sc.master.startswith("local")
    if current and (local or not current.startswith("file:")):
        return current.rstrip("/")
    if not local:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="tidewatch-")
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir().rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for files that a caller writes in a format of its own; ``release`` deletes it."""
    app = spark.sparkContext.applicationId
    path = f"{shared_dir(spark)}/tidewatch-{app}/{name}-{uuid.uuid4().hex}"
    _staged[(app, path)] = path
    return path


def stage(df: DataFrame, name: str, key: str | None = None, compression: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    With a ``key`` the table is written once per application and found again by later calls, so
    that many reports over one input share one copy.
    """
    spark = df.sparkSession
    app = spark.sparkContext.applicationId
    token = (app, f"{name}:{key if key is not None else uuid.uuid4().hex}")
    if token not in _staged:
        path = f"{shared_dir(spark)}/tidewatch-{app}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path, compression=compression)
        _staged[token] = path
    return spark.read.schema(df.schema).parquet(_staged[token])


def find_staged(spark: SparkSession, name: str, key: str) -> DataFrame | None:
    path = _staged.get((spark.sparkContext.applicationId, f"{name}:{key}"))
    return None if path is None else spark.read.parquet(path)


def forget(spark: SparkSession) -> None:
    """Stop reusing keyed tables of this application (their files stay)."""
    app = spark.sparkContext.applicationId
    for token in [t for t in _staged if t[0] == app]:
        del _staged[token]


def release(spark: SparkSession) -> int:
    """Delete the tables this application staged; returns how many."""
    app = spark.sparkContext.applicationId
    tokens = [t for t in _staged if t[0] == app]
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    for token in tokens:
        path = jvm.org.apache.hadoop.fs.Path(_staged.pop(token))
        path.getFileSystem(conf).delete(path, True)
    return len(tokens)


def drop_read_shuffles(spark: SparkSession) -> None:
    """Let the driver collect garbage: Spark then deletes the shuffle files that no plan refers to any more."""
    gc.collect()
    spark._jvm.System.gc()


def measured(df: DataFrame) -> DataFrame:
    """Materialise a statistic so that the planner knows its true size.

    Each call writes a table of its own, so a statistic is never older than the call. Spark broadcasts it
    only if its files are below ``spark.sql.autoBroadcastJoinThreshold`` and otherwise
    sort-merge joins it (with AQE skew splitting). ``release`` deletes it.
    """
    return stage(df, "statistic")
