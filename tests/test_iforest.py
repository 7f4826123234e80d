import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewatch.config import DetectorConfig
from tidewatch.operators import iforest
from tidewatch.schema import MODEL_FEATURES


@pytest.fixture(scope="module")
def points(spark):
    """2,000 ordinary points and 20 planted far ones."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(2020, 5))
    x[2000:] += 8 * rng.choice([-1, 1], size=(20, 5))
    pdf = pd.DataFrame(x, columns=MODEL_FEATURES)
    pdf["order_id"] = [f"P{i}" for i in range(len(pdf))]
    df = spark.createDataFrame(pdf).persist()
    df.count()
    yield df
    df.unpersist()


@pytest.fixture(scope="module")
def forest(points):
    return iforest.fit(points, 2020, trees=100)


def test_bags_have_their_size_and_ignore_partitioning(points):
    def bag(df):
        b = iforest.bags(df, MODEL_FEATURES, 2020, 20, 42)
        return b.groupBy("tree").agg(F.count("*").alias("n"), F.sum(F.xxhash64("order_id").cast("decimal(38,0)")).alias("s")).orderBy("tree").collect()

    one, many = bag(points.coalesce(1)), bag(points.repartition(17))
    assert one == many and len(one) == 20
    assert {r["n"] for r in one} == {256}


def wide_table(spark, n):
    return spark.range(n).select(
        F.concat(F.lit("r"), "id").alias("order_id"), *[F.rand(i).alias(f) for i, f in enumerate(MODEL_FEATURES)]
    )


@pytest.mark.parametrize("n", [50_000, 100_000])
def test_bags_are_drawn_from_all_rows_at_any_size(spark, n):
    drawn = iforest.bags(wide_table(spark, n), MODEL_FEATURES, n, 200, 42).persist()
    assert {r["n"] for r in drawn.groupBy("tree").agg(F.count("*").alias("n")).collect()} == {256}
    # 51,200 draws with repetition between trees
    distinct = drawn.select("order_id").distinct().count()
    assert distinct == pytest.approx(n * (1 - (1 - 256 / n) ** 200), rel=0.02)
    drawn.unpersist()


def test_every_tree_draws_on_its_own(spark):
    rows = wide_table(spark, 20_000).select("order_id", F.explode(iforest._drawn_bags(0.02, 50, 1)).alias("tree"))
    per_tree = [r["n"] for r in rows.groupBy("tree").agg(F.count("*").alias("n")).collect()]
    assert len(per_tree) == 50 and all(300 < n < 500 for n in per_tree)
    per_row = rows.groupBy("order_id").agg(F.count("*").alias("n")).agg(F.sum(F.col("n") * (F.col("n") - 1))).first()[0]
    assert per_row == pytest.approx(20_000 * 50 * 49 * 0.02**2, rel=0.1)


def test_same_seed_same_forest(points, forest):
    again = iforest.fit(points.repartition(5), 2020, trees=100)
    assert np.array_equal(forest.threshold, again.threshold) and np.array_equal(forest.path, again.path)
    other = iforest.fit(points, 2020, trees=100, seed=1)
    assert not np.array_equal(forest.threshold, other.threshold)


def test_scores_are_bounded_and_rank_planted_points_first(points, forest):
    scored = iforest.with_raw_score(points, forest)
    low, high = scored.agg(F.min("iforest_raw"), F.max("iforest_raw")).first()
    assert 0 < low < high <= 1
    top = scored.orderBy(F.desc("iforest_raw")).limit(20).select("order_id").collect()
    assert sum(int(r[0][1:]) >= 2000 for r in top) >= 18


def test_walk_matches_a_plain_tree_walk(points, forest):
    x = points.limit(50).toPandas()[MODEL_FEATURES].to_numpy().T
    got = iforest._walk(forest, x)
    for j in range(x.shape[1]):
        total = 0.0
        for f, t, p in zip(forest.feature, forest.threshold, forest.path):
            node = 0
            for _ in range(forest.height):
                node = 2 * node + (2 if x[f[node], j] > t[node] else 1)
            total += p[node]
        want = 2 ** (-(total / len(forest.feature) / iforest.UNIT) / iforest.mean_path(forest.bag))
        assert got[j] == pytest.approx(want, abs=1e-6)


def test_flag_share_follows_contamination(points):
    counts = []
    for c in (0.02, 0.08, 0.18):
        config = DetectorConfig(iforest_contamination=c, n_trees=50)
        n = iforest.with_forest(points, config, 2020).agg(F.sum("iforest_anomaly")).first()[0]
        assert n == pytest.approx(2020 * c, rel=0.1)
        counts.append(n)
    assert counts[0] < counts[1] < counts[2]


def test_constant_features(spark):
    df = spark.range(50).select(F.col("id").cast("string").alias("order_id"), *[F.lit(1.0).alias(f) for f in MODEL_FEATURES])
    got = iforest.with_forest(df, DetectorConfig(n_trees=5), 50)
    assert got.agg(F.sum("iforest_anomaly")).first()[0] == 0


def test_mean_path_lengths():
    assert iforest.mean_path(1) == 0 and iforest.mean_path(2) == 1
    assert iforest.mean_path(256) == pytest.approx(10.244, abs=1e-3)


def test_missing_features_count_as_the_median(spark):
    df = wide_table(spark, 60).withColumn(MODEL_FEATURES[0], F.when(F.col("order_id") != "r5", F.col(MODEL_FEATURES[0])))
    got = iforest.with_forest(df, DetectorConfig(n_trees=5), 60)
    assert got.where("iforest_score is null").count() == 0 and got.columns == [*df.columns, "iforest_anomaly", "iforest_score", "iforest_skipped"]
