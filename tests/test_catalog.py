"""Every query of the catalog against its SQL twin."""

import os

import duckdb
import pytest

from lamella.plans.registered import ORACLE, QUERIES


@pytest.fixture(scope="module")
def sql(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.sql(f"create view {f[:-8]} as select * from '{sf}/{f}'")
    return c


def rows(df):
    df = df[sorted(df.columns)].copy()
    for k in df.columns:
        if df[k].dtype.kind in "iubf":
            df[k] = df[k].astype("float64").round(3) + 0.0
    return sorted(map(tuple, df.astype(str).replace({"None": "nan", "<NA>": "nan"}).values.tolist()))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, sql, sf, name):
    got, want = QUERIES[name](spark, sf).toPandas(), sql.sql(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 10
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
