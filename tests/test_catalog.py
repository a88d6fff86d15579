"""Every catalog query against its SQL in DuckDB, on the smallest driver tables."""

import os

import pytest

from tidewright.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.sql(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{SF}/{file}'")
    return con


def plain(rows):
    def cell(v):
        if v is None or v != v:
            return None
        return round(float(v), 7) + 0.0 if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v).removesuffix(" 00:00:00")

    return sorted((tuple(map(cell, r)) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_equals_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    want = duck.sql(catalog.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    mine = [tuple(r[got.columns.index(c)] for c in order) for r in got.collect()]
    theirs = [tuple(r[want.columns.index(c)] for c in order) for r in want.fetchall()]
    assert plain(mine) == plain(theirs)


def test_entry_imports():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
