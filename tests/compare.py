"""Runs a catalogue query and its oracle on the same tables and compares all values."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pandas as pd


def oracle(sql: str, sf_dir: str) -> pd.DataFrame:
    connection = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).split(".")[0]
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection.execute(sql).df()


def _value(v: object) -> str:
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, float):
        return repr(v + 0.0)
    return str(v)


def canonical(df: pd.DataFrame) -> list[tuple[str, ...]]:
    columns = sorted(df.columns)
    return sorted(tuple(_value(v) for v in row) for row in df[columns].itertuples(index=False, name=None))


def differences(spark_df: pd.DataFrame, oracle_df: pd.DataFrame) -> str | None:
    if sorted(spark_df.columns) != sorted(oracle_df.columns):
        return f"columns {sorted(spark_df.columns)} != {sorted(oracle_df.columns)}"
    for c in oracle_df.columns:
        # Whole numbers with nulls come from Spark as floats.
        if str(oracle_df[c].dtype) == "Int64" and spark_df[c].dtype.kind == "f":
            spark_df = spark_df.assign(**{c: spark_df[c].astype("Int64")})
    if len(spark_df) != len(oracle_df):
        return f"rows {len(spark_df)} != {len(oracle_df)}"
    kinds = [(c, spark_df[c].dtype.kind, oracle_df[c].dtype.kind) for c in spark_df.columns]
    clash = [k for k in kinds if k[1] != k[2] and "O" not in k[1:]]
    if clash:
        return f"types {clash}"
    a, b = canonical(spark_df), canonical(oracle_df)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} rows differ, first {bad[0]}" if bad else None
