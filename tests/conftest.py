import sys
from datetime import datetime, timedelta
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tests"))


@pytest.fixture(scope="session")
def spark():
    from tidewatch.session import get_session

    session = get_session(
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "6g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


COLUMNS = [
    "order_id", "carrier", "cargo_type", "mode", "origin", "dest", "ship_ts", "plan_arrival_ts",
    "actual_arrival_ts", "planned_days", "delay_days", "weight_t", "freight_usd",
]


def order_rows(delays, carriers=None, modes=None, origins=None, dests=None):
    """Orders with a 10-day plan, one per day, all cells as text; ``n`` gives the input order."""
    day = lambda d: d.strftime("%Y-%m-%d")
    rows = []
    for i, delay in enumerate(delays):
        ship = datetime(2024, 1, 1) + timedelta(days=i)
        plan = ship + timedelta(days=10)
        rows.append(
            {
                "n": i,
                "order_id": f"T-{i:04d}",
                "carrier": carriers[i] if carriers else "carrier A",
                "cargo_type": "test cargo",
                "mode": modes[i] if modes else "sea",
                "origin": origins[i] if origins else "Shanghai",
                "dest": dests[i] if dests else "Singapore",
                "ship_ts": day(ship),
                "plan_arrival_ts": day(plan),
                "actual_arrival_ts": day(plan + timedelta(days=float(delay))),
                "planned_days": "10",
                "delay_days": str(delay),
                "weight_t": str(10 + i * 0.5),
                "freight_usd": str(1000 + i * 37),
            }
        )
    return rows


@pytest.fixture
def orders(spark):
    def make(delays=(), rows=None, **kw):
        rows = order_rows(delays, **kw) if rows is None else rows
        schema = "n long, " + ", ".join(f"{c} string" for c in COLUMNS)
        return spark.createDataFrame([tuple(r[c] for c in ["n", *COLUMNS]) for r in rows], schema)

    return make


@pytest.fixture
def valid(spark, orders):
    """Validated, staged orders for the detector."""
    from tidewatch.operators.validate import valid_orders

    def make(delays, **kw):
        return valid_orders(orders(delays, **kw), ["n"])

    return make


@pytest.fixture(scope="session")
def detected(spark):
    """Ten already detected orders: nine critical, five z-score hits, three forest hits."""
    rows = []
    for i in range(10):
        hit = i < 9
        rows.append(
            (
                f"M-{i}", "A" if i < 6 else "B", "r1" if i % 2 == 0 else "r2", "sea",
                datetime(2024, 1, 1) + timedelta(days=i), 2024, 1, 16.0 if hit else 0.0, 10.0,
                int(hit), "critical" if hit else "normal", int(hit), int(i < 5), int(i < 3),
                ["delay_over_14d"] if hit else [], "rules" if hit else "none",
                100.0 if hit else 0.0, "test reason" if hit else "not anomalous",
            )
        )
    schema = (
        "order_id string, carrier string, route string, mode string, ship_ts timestamp_ntz, ship_year int, "
        "ship_month int, delay_days double, planned_days double, final_anomaly int, severity string, "
        "rule_anomaly int, zscore_anomaly int, iforest_anomaly int, rule_codes array<string>, "
        "anomaly_methods string, anomaly_score double, reason string"
    )
    return spark.createDataFrame(rows, schema)
