"""Rows of Spark and DuckDB in one form."""

import math

import duckdb

from torusflow.plans.views import TABLES


def plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)):
        return int(v) if math.isfinite(v) and v == int(v) else round(float(v), 6)
    return str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def oracle(sf_dir, sql):
    con = duckdb.connect(config={"temp_directory": "", "memory_limit": "4GB", "threads": "2"})
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    got = con.sql(sql)
    return sorted(got.columns), rows(got.columns, got.fetchall())


def spark_rows(df):
    return sorted(df.columns), rows(df.columns, [tuple(r) for r in df.collect()])
