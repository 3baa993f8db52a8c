"""Rows of a Spark query and of its SQL in DuckDB, made comparable."""

import glob
import math
import os

import duckdb

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def connect(folder=DATA):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        files = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{files}'")
    return con


def plain(v):
    if v is None or isinstance(v, bool):
        return v
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return None if math.isnan(v) else round(float(v), 6)
    return str(v).split("+")[0].replace(" 00:00:00", "")


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=str)


def same(spark_df, con, sql):
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    assert sorted(spark_df.columns) == sorted(names)
    assert rows_of(spark_df.columns, spark_df.collect()) == rows_of(names, found.fetchall())
