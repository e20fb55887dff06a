"""Every registered query against the SQL registered beside it, in another engine."""

import datetime
import decimal
import math
import os
from pathlib import Path

import duckdb
import pytest

from orrery.queries import load
from orrery.queries.registry import TABLES

QUERIES, ORACLE = load()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        if Path(sf_dir, f"{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(sf_dir, t)}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float, decimal.Decimal)):
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, datetime.datetime):
        return v.isoformat(" ")
    return str(v)


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    names = sorted(df.columns)
    got = ordered(tuple(plain(r[c]) for c in names) for r in df.collect())
    found = duck.execute(ORACLE[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == names
    want = ordered(tuple(plain(r[columns.index(c)]) for c in names) for r in found.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_without_sql_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0
