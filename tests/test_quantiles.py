import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tidewatch.operators.quantiles import grouped_quantiles, single_quantiles

PROBS = [0.0, 0.01, 0.25, 0.5, 1.0]


def check(spark, groups, **options):
    rows = [(k, v) for k, vs in groups.items() for v in vs]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r["k"]: r for r in grouped_quantiles(df, ["k"], "v", PROBS, **options).collect()}
    for k, vs in groups.items():
        vs = [v for v in vs if v is not None]
        if not vs:
            continue
        assert got[k]["n"] == len(vs)
        want = np.quantile(vs, PROBS)
        assert np.allclose([got[k][f"q{i}"] for i in range(len(PROBS))], want, rtol=1e-12, atol=1e-12)


SAMPLES = {
    "flat": [3.0] * 50,
    "ties": [0.0] * 40 + [1.0] * 3 + [7.5],
    "wide": [float(10.0**i) for i in range(-20, 21)] + [-1e30],
    "one": [42.0],
    "nulls": [None, 1.0, None, 2.0],
    None: [5.0, 6.0, 7.0],
}


@pytest.mark.parametrize("options", [{}, {"accuracy": 8}, {"accuracy": 100}])
def test_quantiles_of_awkward_groups(spark, options):
    check(spark, SAMPLES, **options)


@settings(max_examples=2, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.dictionaries(
        st.sampled_from("ab"),
        st.lists(st.floats(-1e9, 1e9).map(lambda x: round(x, 2)), min_size=1, max_size=60),
        min_size=1,
    )
)
def test_counting_equals_sorting(spark, groups):
    check(spark, groups, accuracy=20)


def test_single_group_and_hot_group(spark):
    df = spark.range(20_000).selectExpr("CAST(id % 997 AS DOUBLE) AS v")
    small = single_quantiles(df, "v", [0.95]).first()
    large = single_quantiles(df, "v", [0.95], accuracy=50).first()
    assert small == large


def test_infinities_rank_at_the_ends_and_nan_is_no_value(spark):
    inf = float("inf")
    rows = [("a", v) for v in [25.0] * 5 + [1.0, 50.0, inf, float("nan")]] + [("b", v) for v in [0.0, 5e-324, 5e-324, -inf]]
    df = spark.createDataFrame(rows, "k string, v double")
    for accuracy in (10_000, 5):
        got = {r["k"]: r for r in grouped_quantiles(df, ["k"], "v", [0.0, 0.5, 1.0], accuracy=accuracy).collect()}
        assert [got["a"][c] for c in ("n", "q0", "q1", "q2")] == [8, 1.0, 25.0, inf]
        assert [got["b"][c] for c in ("n", "q0", "q2")] == [4, -inf, 5e-324]


def test_two_scans_leave_nothing_cached(spark):
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    df = spark.range(5000).selectExpr("CAST(id % 7 AS INT) AS k", "CAST(id AS DOUBLE) AS v")
    assert grouped_quantiles(df, ["k"], "v", [0.5], accuracy=100).count() == 7
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before
