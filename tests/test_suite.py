"""Every registered query next to its SQL oracle on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tests.oracle_check import TABLES, compare

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return connection


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    status, _, _, note = compare(spark, SF, name, entry.queries()[name], entry.oracle_sql().get(name), con)
    assert status in ("ok", "rows-only"), note


def test_relationships_are_sought_in_all_columns(spark, con, monkeypatch):
    from ledgerloom.operators import relations

    seen = []
    monkeypatch.setattr(relations, "discover_relationships", lambda datasets, *_: seen.append({t: len(df.columns) for t, df in datasets.items()}) or spark.range(0))
    entry.queries()["r2_all_relationships"](spark, SF)
    assert seen == [{t: len(con.sql(f"select * from {t}").columns) for t in TABLES}]
