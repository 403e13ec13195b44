"""Every named query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_points

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(entry_points.queries()))
def test_query(spark, duck, name):
    df = entry_points.queries()[name](spark, SF)
    rows = df.collect()
    sql = entry_points.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    found = duck.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(names)
    expected = sorted((repr([r[names.index(c)] for c in sorted(names)]) for r in found.fetchall()))
    assert sorted(repr([r[c] for c in sorted(names)]) for r in rows) == expected


def test_entry(spark):
    assert len(entry_points.entry(spark).collect()) == 10
