"""Running a query and its SQL twin on the same tables."""

import glob
import math
import os

import duckdb


def _value(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return v


def rows_of(df):
    columns = sorted(df.columns)
    return columns, sorted((tuple(_value(v) for v in r) for r in df.select(*(f"`{c}`" for c in columns)).collect()), key=str)


def sql_rows(sql, d):
    con = duckdb.connect()
    for f in glob.glob(f"{d}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    rel = con.execute(sql)
    names = [x[0] for x in rel.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), sorted((tuple(_value(r[i]) for i in order) for r in rel.fetchall()), key=str)
