"""Compares a Spark result with DuckDB's, rows in any order."""

import glob
import os

import duckdb


def connection(sf_dir):
    c = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def canonical(df, columns):
    def one(v):
        if v is None or v != v:
            return "None"
        if isinstance(v, int | float) or type(v).__name__.startswith(("int", "float", "uint", "Decimal")):
            return repr(round(float(v), 9))
        return str(v)

    return df[columns].map(one).sort_values(columns).reset_index(drop=True)


def assert_same(spark_df, sql, con):
    got, want = spark_df.toPandas(), con.execute(sql).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    a, b = canonical(got, columns), canonical(want, columns)
    assert len(a) == len(b)
    assert a.equals(b), (a[(a != b).any(axis=1)].head(3), b[(a != b).any(axis=1)].head(3))
