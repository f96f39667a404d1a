"""Every named query outside the training-data operators against its SQL, over whole tables."""

import datetime
import decimal
import math
import os

import pytest

from quietlake.plans import catalogue, dialogue_queries, memory_queries  # noqa: F401

SF = os.environ.get("QUERY_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for name in os.listdir(SF):
        if name.endswith(".parquet"):
            c.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return c


def plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return [plain(x) for x in v] if isinstance(v, list | tuple) else v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, name):
    want = duck.execute(catalogue.ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    got = catalogue.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    rows = want.fetchall()
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == rows_of(columns, rows)


def test_queries_without_sql_have_rows(spark):
    for name in sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)):
        assert catalogue.QUERIES[name](spark, SF).count() > 0, name
