"""Every query with SQL gives the same rows as DuckDB."""

import math
from decimal import Decimal

import duckdb
import pytest

from tidemill import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


@pytest.fixture(scope="session")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", list(queries.SQL))
def test_query(spark, sf, duck, name):
    df = queries.QUERIES[name](spark, sf)
    sql = duck.sql(queries.SQL[name])
    assert sorted(df.columns) == sorted(sql.columns)
    assert rows(df.columns, df.collect()) == rows(sql.columns, sql.fetchall())


def test_entry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_pushdown(spark, sf):
    """A filter and a projection reach the scan."""
    plan = queries.QUERIES["filter_events"](spark, sf)._jdf.queryExecution().toString()
    assert "PushedFilters: [" in plan and "props" not in plan.split("ReadSchema")[-1].split("\n")[0]


def test_lineage_sample(spark, sf):
    a, b = ({r[0] for r in queries.QUERIES["lineage_sample"](spark, sf).collect()} for _ in range(2))
    n = spark.read.parquet(f"{sf}/orders.parquet").count()
    assert a == b and 0.05 * n < len(a) < 0.2 * n
