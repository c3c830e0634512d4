"""Compares rows of Spark and DuckDB whatever their order."""

import math
from decimal import Decimal

import duckdb
from evenmark.fixtures import TABLES

SMALL = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, float | Decimal):
        return "nan" if math.isnan(v) else round(float(v), 6) + 0.0
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    return v


def rows_of(columns, rows):
    at = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in at) for r in rows), key=lambda r: str([float(x) if isinstance(x, int) and not isinstance(x, bool) else x for x in r]))


def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c
