"""Every registered query against its SQL on the smallest tables, and plan checks."""

import os

import pytest

from compare import connect, differences
import __spark_entry__ as entry
from tidewatch.plans import oracles
from tidewatch.plans import queries as registered
from tidewatch.config import DetectorConfig
from tidewatch.operators.features import preprocess
from tidewatch.plans.detect import run_layers
from tidewatch.plans.queries import base
from tidewatch.sources import staging

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")



@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_sql():
    assert set(registered.queries()) == set(oracles.oracle_sql())
    assert set(registered.queries()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    got = entry.queries()[name](spark, SF).toPandas()
    assert differences(got, con.execute(entry.oracle_sql()[name]).df()) is None


def test_forest_queries_cover_every_order(spark):
    rows = entry.queries()["shipments"](spark, SF).count()
    flagged = entry.queries()["iforest_scores"](spark, SF).toPandas()
    assert len(flagged) == rows
    assert flagged["iforest_anomaly"].mean() == pytest.approx(0.05, abs=0.01)


def test_entry_gives_ranked_anomalies(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 10
    assert [r["anomaly_score"] for r in rows] == sorted((r["anomaly_score"] for r in rows), reverse=True)


def test_detection_reads_once_and_never_shuffles_the_orders(spark):
    result = run_layers(base(spark, SF), DetectorConfig(), forest=False)
    plan = result._jdf.queryExecution().executedPlan().toString()
    top = plan.split("InMemoryRelation")[0]
    assert "Exchange hashpartitioning" not in top and "SortMergeJoin" not in top


def test_large_statistics_are_not_broadcast(spark):
    small = run_layers(base(spark, SF), DetectorConfig(), forest=False).where("final_anomaly = 1").count()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100")
    try:
        result = run_layers(base(spark, SF), DetectorConfig(), forest=False)
        assert "BroadcastHashJoin" not in result._jdf.queryExecution().optimizedPlan().toString()
        assert "SortMergeJoin" in result._jdf.queryExecution().sparkPlan().toString()
        assert result.where("final_anomaly = 1").count() == small > 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_staged_tables_are_reused_and_released(spark):
    a, b = base(spark, SF), base(spark, SF)
    assert a.inputFiles() == b.inputFiles()
    df = staging.stage(preprocess(spark.read.parquet(*[f for f in a.inputFiles()])), "scratch")
    assert df.count() > 0
    assert staging.release(spark) >= 1
