"""Every text query with SQL gives what the SQL gives in another engine."""

import duckdb
import pytest

from transferwatch.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ORACLES)
def test_query_equals_sql(spark, name):
    duck = duckdb.connect()
    for table in ("documents", "embeddings", "conversations"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    result = duck.execute(ORACLES[name])
    columns = [c[0] for c in result.description]
    frame = QUERIES[name](spark, SF)
    assert sorted(columns) == sorted(frame.columns)
    assert sorted(map(tuple, frame.select(*columns).collect())) == sorted(result.fetchall())
