"""All registered queries run, and those with SQL agree with DuckDB."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__
from lexolith import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.sql("SET timezone='UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(df, columns):
    return sorted(tuple(repr(None if v is None or v != v else v.item() if hasattr(v, "item") else v) for v in r) for r in df[columns].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    if name in catalog.ORACLE_SQL:
        want = con.sql(catalog.ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert plain(got, sorted(got.columns)) == plain(want, sorted(got.columns))


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() >= 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
