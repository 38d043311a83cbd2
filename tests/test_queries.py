"""Every registered query against its SQL on the smallest scale."""

import duckdb
import pytest

import __spark_entry__ as contract
from check import TABLES, normal

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    return con


def test_every_oracle_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry_is_lazy_and_has_rows(spark):
    assert contract.entry(spark).count() == 6


@pytest.mark.parametrize("name", sorted(contract.queries()))
def test_query(spark, duck, name):
    df = contract.queries()[name](spark, SMALL)
    got = normal([tuple(r) for r in df.collect()], df.columns)
    sql = contract.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    cur = duck.execute(sql)
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == normal(cur.fetchall(), columns)
