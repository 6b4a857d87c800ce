"""Runs a query and its SQL side by side, as the driver does."""

import glob
import os

import duckdb
import pandas as pd


def connection(sf_dir):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(p)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{p}'")
    return con


def plain(df):
    df = df[sorted(df.columns)].astype(object).where(df.notna(), None)
    rows = [tuple(str(int(v)) if isinstance(v, float) and v.is_integer() else str(v) for v in r) for r in df.itertuples(index=False)]
    return sorted(rows), sorted(df.columns)


def differences(spark_df, con, sql):
    got, want = spark_df.toPandas(), con.execute(sql).df()
    (a, ca), (b, cb) = plain(pd.DataFrame(got)), plain(pd.DataFrame(want))
    if ca != cb:
        return f"columns {ca} and {cb}"
    if a != b:
        return f"{len(a)} and {len(b)} rows; first: {[x for x in a if x not in set(b)][:2]} and {[x for x in b if x not in set(a)][:2]}"
    return ""
