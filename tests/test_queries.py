"""Every registered query against its SQL on the smallest tables, and the entry points."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from ostinato.plans.registry import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def database(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    return value


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf_dir, database):
    found = QUERIES[name](spark, sf_dir)
    rows = found.collect()
    sql = database.sql(ORACLES[name])
    columns = sorted(found.columns)
    assert columns == sorted(sql.columns)
    at = [sql.columns.index(c) for c in columns]
    expected = sorted((tuple(plain(r[i]) for i in at) for r in sql.fetchall()), key=str)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in rows), key=str) == expected


def test_entry(spark):
    assert entry.entry(spark).columns
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
