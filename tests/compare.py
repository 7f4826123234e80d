"""Run registered queries and their SQL side by side."""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if pd.api.types.is_integer_dtype(df[c]) and df[c].isna().any():  # the other side may hold it as floats
            df[c] = df[c].astype("float64")
        if pd.api.types.is_float_dtype(df[c]):
            df[c] = df[c].map(lambda v: "null" if pd.isna(v) else f"{v:.9g}")
        elif pd.api.types.is_datetime64_any_dtype(df[c]):
            df[c] = df[c].map(lambda v: "null" if pd.isna(v) else v.isoformat())
        else:
            df[c] = df[c].map(lambda v: "null" if v is None or v is pd.NA or v != v else str(v))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def differences(spark_df: pd.DataFrame, sql_df: pd.DataFrame) -> str | None:
    if sorted(spark_df.columns) != sorted(sql_df.columns):
        return f"columns {sorted(spark_df.columns)} / {sorted(sql_df.columns)}"
    if len(spark_df) != len(sql_df):
        return f"rows {len(spark_df)} / {len(sql_df)}"
    a, b = canonical(spark_df), canonical(sql_df)
    unequal = (a != b).any(axis=1)
    if unequal.any():
        i = unequal.idxmax()
        bad = [c for c in a.columns if a.at[i, c] != b.at[i, c]]
        return f"{int(unequal.sum())} rows differ, first in {bad}: {a.loc[i, bad].tolist()} / {b.loc[i, bad].tolist()}"
    return None


def main(sf_dir: str, names: list[str]) -> int:
    import __spark_entry__ as entry
    from tidewatch.session import get_session

    spark = get_session(
        "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                       "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, sql, failed = connect(sf_dir), entry.oracle_sql(), 0
    for name, query in entry.queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            got = query(spark, sf_dir).toPandas()
            took = time.time() - start
            if name not in sql:
                print(f"rows  {name} {len(got)} {took:.1f}s", flush=True)
                continue
            problem = differences(got, con.execute(sql[name]).df())
        except Exception as exc:  # report and go on
            con = connect(sf_dir)
            problem, took, got = f"{type(exc).__name__}: {str(exc)[:600]}", time.time() - start, []
        failed += problem is not None
        print(f"{'FAIL' if problem else 'ok  '}  {name} {len(got)} {took:.1f}s {problem or ''}", flush=True)
    return failed


if __name__ == "__main__":
    sys.path.insert(0, ".")
    sys.exit(main(sys.argv[1], sys.argv[2:]))
