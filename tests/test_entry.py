"""Each query with SQL against DuckDB on the smallest tables."""

import datetime
import os

import duckdb
import pytest

import __spark_entry__
from taskloom import queries as core
from taskloom import service_queries as services

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def comparable(rows):
    def one(v):
        if isinstance(v, float):
            return round(v, 4)
        return str(v) if isinstance(v, (datetime.date, datetime.datetime)) else v

    return sorted(repr([one(v) for v in r]) for r in rows)


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted({**core.ORACLES, **services.ORACLES}))
def test_query_against_sql(spark, duck, name):
    df = {**core.QUERIES, **services.QUERIES}[name](spark, SF)
    want = duck.sql({**core.ORACLES, **services.ORACLES}[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert comparable(tuple(r) for r in df.select(want.columns).collect()) == comparable(want.fetchall())


def test_every_query_of_the_engine_has_sql():
    assert set(core.QUERIES) == set(core.ORACLES) and set(services.QUERIES) == set(services.ORACLES)


def test_entry_module():
    names = __spark_entry__.queries()
    assert set(core.QUERIES) <= set(names) and set(__spark_entry__.oracle_sql()) <= set(names)
