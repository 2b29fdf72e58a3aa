"""Every query of the library against its SQL in DuckDB, on the small tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from convolake.plans import registry

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF_DIR):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF_DIR}/{name}'")
    return con


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return tuple(map(_plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_agrees_with_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF_DIR)
    columns = sorted(df.columns)
    got = sorted((_plain([r[c] for c in columns]) for r in df.collect()), key=repr)
    if name not in registry.ORACLE_SQL:
        assert columns
        return
    found = duck.sql(registry.ORACLE_SQL[name])
    assert sorted(found.columns) == columns
    want = sorted((_plain([r[found.columns.index(c)] for c in columns]) for r in found.fetchall()), key=repr)
    assert got == want
    assert not [t for t in map(str, found.types) if "HUGEINT" in t]


def test_every_sql_has_a_query():
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)
