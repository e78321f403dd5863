"""Every query with SQL gives what the SQL gives in another engine."""

import importlib
import sys

import duckdb
import pytest

from tests.conftest import SF
from transferwatch.oracle import ORACLES
from transferwatch.queries import QUERIES

TABLES = ["customer", "supplier", "orders", "lineitem", "events", "documents", "labels"]


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return connection


def comparable(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(
        tuple(str(r[i] + 0.0 if isinstance(r[i], float) else r[i]) for i in order) for r in rows
    )


@pytest.mark.parametrize("name", ORACLES)
def test_query_equals_sql(spark, duck, name):
    frame = QUERIES[name](spark, SF)
    result = duck.execute(ORACLES[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(frame.columns)
    found = [tuple(r) for r in frame.collect()]
    assert comparable(found, frame.columns) == comparable(result.fetchall(), columns)


def test_every_sql_belongs_to_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_without_the_text_queries(monkeypatch):
    import __spark_entry__

    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)  # importing it now fails
    importlib.reload(__spark_entry__)
    assert set(__spark_entry__.queries()) == set(QUERIES)
    assert set(__spark_entry__.oracle_sql()) == set(ORACLES)
    monkeypatch.undo()
    importlib.reload(__spark_entry__)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 24
