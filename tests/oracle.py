"""Runs a registered query and its SQL on the same tables."""

import duckdb

DATA = "/root/testdata/sf0.001"
TABLES = ("documents", "pages", "benchmark", "labels", "conversations", "events")


def rows_of(df):
    columns = sorted(df.columns)
    return columns, sorted(repr(tuple(r)) for r in df.select(*(f"`{c}`" for c in columns)).collect())


def sql_rows(sql, data=DATA):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{data}/{t}.parquet'")
    found = con.sql(sql)
    columns = sorted(found.columns)
    return columns, sorted(map(repr, found.project(", ".join(f'"{c}"' for c in columns)).fetchall()))
