"""Rows of a Spark query and of its SQL on the same files, in comparable form."""

from __future__ import annotations

import math

import duckdb

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, bool) or isinstance(value, str):
        return value
    if isinstance(value, int | float):
        return round(float(value), 6)
    return str(value)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def both(spark, con, query, sql: str, sf_dir: str):
    df = query(spark, sf_dir)
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    return (sorted(df.columns), rows(df.columns, df.collect())), (sorted(names), rows(names, cursor.fetchall()))
