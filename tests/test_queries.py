"""Every query with SQL against DuckDB on the small tables, compared as sets of rows."""

import datetime
import math

import duckdb
import pytest

from argusframe.plans import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, datetime.datetime):
        return x.isoformat()
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6) + 0.0
    if type(x).__name__ == "Decimal":
        return round(float(x), 6)
    return x


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=str)


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(name, spark, small, duck):
    df = queries.queries()[name](spark, small)
    cursor = duck.execute(queries.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    want, found = rows_of(names, cursor.fetchall()), rows_of(df.columns, df.collect())
    assert found == want


def test_queries_without_sql_run(spark, small):
    """What has no SQL is held against a plain model elsewhere; here it runs on the driver's tables."""
    for name in set(queries.queries()) - set(queries.oracle_sql()):
        assert queries.queries()[name](spark, small).count() > 0
