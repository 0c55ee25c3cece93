"""Every registered query with SQL gives the rows that DuckDB computes."""

import os

import duckdb
import pytest

from scholia.plans import queries
from scholia.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    found = duckdb.connect()
    for name in os.listdir(SF):
        found.sql(f"create view {name.removesuffix('.parquet')} as select * from '{SF}/{name}'")
    return found


@pytest.fixture(scope="module", autouse=True)
def one_scan(spark):
    """All queries of the module read one scan, which is given back."""
    yield
    queries.forget()
    spark.catalog.clearCache()


def rows(columns, held):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(round(r[i], 6)) if isinstance(r[i], float) else str(r[i]) for i in order) for r in held)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    found = QUERIES[name](spark, SF)
    expected = db.sql(SQL[name])
    assert sorted(found.columns) == sorted(expected.columns)
    assert rows(found.columns, found.collect()) == rows(expected.columns, expected.fetchall())
