import pytest
from pyspark.sql import functions as F

from conftest import order_rows
from tidewatch import DataValidationError, DetectorConfig
from tidewatch.operators.features import preprocess
from tidewatch.plans.detect import run_layers
from tidewatch.streaming.verdicts import judge, judge_batches, load_statistics, save_statistics

SEEN = ["order_id", "rule_anomaly", "rule_reason", "z_score", "zscore_skipped", "anomaly_votes", "final_anomaly", "anomaly_score", "severity", "reason"]


@pytest.fixture
def orders_of(valid):
    delays = [0, 1, 0, 2, 1, 0, 3, 0, 1, 20, 0, 8, 1, 2, 0, 1, 0, 2, 30, 1, 0, 0, 1, 9]
    dests = ["Singapore" if i % 5 else "Busan" for i in range(len(delays))]
    return valid(delays, dests=dests, modes=["sea" if i % 2 else "air" for i in range(len(delays))])


def facts(df):
    return sorted(tuple(r) for r in df.select(SEEN).collect())


def streamed(spark, frame, path):
    frame.repartition(4).write.parquet(path)
    return spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_a_stream_gets_the_verdicts_of_the_batch(spark, orders_of, tmp_path):
    folder = str(tmp_path / "statistics")
    assert save_statistics(orders_of, folder) == 1
    stream = judge(streamed(spark, orders_of, str(tmp_path / "in")), load_statistics(spark, folder))
    assert stream.isStreaming
    query = stream.writeStream.format("memory").queryName("judged").start()
    query.processAllAvailable()
    query.stop()
    batch = run_layers(preprocess(orders_of), DetectorConfig(), forest=False)
    assert facts(spark.table("judged")) == facts(batch)
    assert batch.where("severity = 'critical'").count() > 0 and batch.where("zscore_anomaly = 1").count() > 0


def test_each_batch_reads_the_newest_statistics(spark, orders_of, tmp_path):
    folder, seen = str(tmp_path / "statistics"), []
    save_statistics(orders_of.limit(3), folder)
    write = lambda df, number: seen.append((number, df.where("zscore_skipped").count(), df.count()))
    source = streamed(spark, orders_of, str(tmp_path / "in"))
    writer = judge_batches(source, folder, lambda df, n: (write(df, n), save_statistics(orders_of, folder)) and None)
    query = writer.option("checkpointLocation", str(tmp_path / "log")).start()
    query.processAllAvailable()
    query.stop()
    assert len(seen) == 4 and sum(n for *_, n in seen) == orders_of.count()
    assert seen[0][1] == seen[0][2] and all(skipped < n for _, skipped, n in seen[1:])
    assert load_statistics(spark, folder).version == 5


def test_new_orders_are_measured_against_all_of_their_route(spark, orders_of, tmp_path):
    folder = str(tmp_path / "statistics")
    save_statistics(orders_of, folder)
    new = orders_of.limit(2).withColumns({"delay_days": F.lit(40.0), "dest": F.when(F.col("order_id") == "T-0000", "Nowhere").otherwise("Singapore")})
    rows = {r["dest"]: r for r in judge(new, load_statistics(spark, folder), included=False).collect()}
    assert rows["Nowhere"]["zscore_skipped"] and rows["Nowhere"]["z_score"] == 0
    same = preprocess(orders_of).where(F.col("dest") == "Singapore").agg(F.avg("delay_days"), F.stddev_samp("delay_days")).first()
    assert rows["Singapore"]["z_score"] == pytest.approx((40 - same[0]) / same[1], abs=2e-3)


def test_versions(spark, orders_of, tmp_path):
    folder = str(tmp_path / "statistics")
    with pytest.raises(DataValidationError):
        load_statistics(spark, folder)
    assert [save_statistics(orders_of, folder) for _ in range(2)] == [1, 2]
    assert load_statistics(spark, folder, 1).version == 1
    with pytest.raises(DataValidationError):
        load_statistics(spark, folder, 7)
    (tmp_path / "statistics" / "version=9" / "floors").mkdir(parents=True)  # not complete
    assert load_statistics(spark, folder).version == 2
    assert order_rows([1])
