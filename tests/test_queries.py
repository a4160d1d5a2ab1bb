"""Every query against its oracle in DuckDB, on the smallest tables."""

import decimal

import duckdb
import pytest

import __spark_entry__

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ORACLE = __spark_entry__.oracle_sql()


@pytest.fixture(scope="module")
def oracle(data):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{data}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 7)
    if isinstance(v, decimal.Decimal):
        return int(v) if v == int(v) else float(v)
    return tuple(map(plain, v)) if isinstance(v, list) else v


def rows(columns, found):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=lambda r: [(x is None, str(x)) for x in r])


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, data, oracle, name):
    df = __spark_entry__.queries()[name](spark, data)
    want = oracle.sql(ORACLE[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, df.collect()) == rows(list(want.columns), want.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
