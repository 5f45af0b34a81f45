"""Every registered query of the library against its SQL, as the driver compares them."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from millrace import queries

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def database():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{DATA}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, database, name):
    got = queries.QUERIES[name](spark, DATA)
    want = database.sql(queries.ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    order = [want.columns.index(c) for c in columns]
    assert sorted(repr(tuple(r[c] for c in columns)) for r in got.collect()) == sorted(repr(tuple(r[i] for i in order)) for r in want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(queries.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert queries.QUERIES["storage_stats"](spark, DATA).first()["size_bytes"] > 0


def test_the_queries_stand_without_the_operators(monkeypatch):
    """Whatever can't be imported, the library's own queries are there."""

    def missing(name):
        raise ImportError(name)

    monkeypatch.setattr(entry.importlib, "import_module", missing)
    assert set(entry.queries()) == set(queries.QUERIES) and set(entry.oracle_sql()) == set(queries.ORACLES)
