"""Every registered query against its SQL on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ORACLE = entry.oracle_sql()
FAMILY = {"tinyint": "int", "smallint": "int", "integer": "int", "int": "int", "bigint": "int", "double": "float", "float": "float", "varchar": "text", "string": "text", "boolean": "bool", "timestamp": "time", "timestamp_ntz": "time", "date": "date"}


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    return str(v)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, sf, duck, name):
    got = entry.queries()[name](spark, sf)
    want = duck.sql(ORACLE[name])
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    kinds = dict(zip(want.columns, (FAMILY.get(str(t).lower(), str(t)) for t in want.types), strict=True))
    assert {c: FAMILY.get(t, t) for c, t in got.dtypes} == kinds
    at = [list(want.columns).index(c) for c in names]
    assert sorted(tuple(plain(r[c]) for c in names) for r in got.collect()) == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
