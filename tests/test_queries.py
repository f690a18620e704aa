"""Every query with an oracle against DuckDB on the smallest tables, and contracts of the catalogue."""

import math
import os
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as entry
from metrolith.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    v = float(v) if isinstance(v, Decimal) else v
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return round(v, 4) + 0.0 if isinstance(v, float) else str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=str)


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_equals_duckdb(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF)
    want = duck.execute(catalogue.ORACLES[name])
    columns, data = [d[0] for d in want.description], want.fetchall()
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(columns, data)


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(catalogue.ORACLES) <= set(catalogue.QUERIES)
    assert set(entry.oracle_sql()) <= set(entry.queries())
