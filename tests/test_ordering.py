"""Time order with its ranks and files, and sketches that merge."""

import pytest
from pyspark.sql import functions as F

from transferwatch.operators import sketches
from transferwatch.operators.ordering import time_ordered, write_time_ordered
from transferwatch.schema import SENDER


def test_places_are_those_of_a_plain_sort(tx):
    """A third of the rows at one moment, and some without a time."""
    chance = F.pmod(F.xxhash64("txn_id"), F.lit(9))
    busy = F.to_timestamp(F.lit("2022-09-05 12:00:00"))
    rows = tx.withColumn("ts", F.when(chance < 3, busy).when(chance < 8, F.col("ts")))
    found = [(r.place, r.ts, r.txn_id) for r in time_ordered(rows).select("place", "ts", "txn_id").collect()]
    plain = sorted((r.ts is not None, r.ts, r.txn_id) if r.ts else (False, None, r.txn_id)
                   for r in rows.select("ts", "txn_id").where("ts is not null").collect())
    missing = sorted(r.txn_id for r in rows.where("ts is null").select("txn_id").collect())
    wanted = [(None, i) for i in missing] + [(ts, i) for _, ts, i in plain]
    assert [(ts, i) for _, ts, i in sorted(found)] == wanted
    assert sorted(p for p, _, _ in found) == list(range(1, len(found) + 1))


def test_empty_table_in_order(tx):
    assert time_ordered(tx.where("false")).count() == 0


def test_files_hold_ranges_of_time(spark, tx, tmp_path):
    write_time_ordered(tx, f"{tmp_path}/t", files=4)
    table = spark.read.parquet(f"{tmp_path}/t").withColumn("file", F.col("_metadata.file_path"))
    files = table.groupBy("file").agg(F.min("ts").alias("a"), F.max("ts").alias("b")).orderBy("a").collect()
    assert len(files) > 1 and table.count() == tx.count()
    assert all(left.b <= right.a for left, right in zip(files, files[1:]))


def test_distinct_sketches_merge(tx):
    whole = sketches.estimated_distinct(sketches.distinct_sketch(tx, SENDER), SENDER)
    parts = [sketches.distinct_sketch(tx.where(F.col("from_bank") % 2 == i), SENDER) for i in (0, 1)]
    merged = sketches.merged_distinct(parts[0].unionByName(parts[1]), SENDER)
    assert sketches.estimated_distinct(merged, SENDER).exceptAll(whole).isEmpty()


def test_quantile_sketches_merge_within_their_error(spark):
    rows = spark.range(100_000).selectExpr(
        "cast(id * 7919 % 100000 as double) as amount_paid", "id % 7 as part",
        "if(id % 10 = 0, double('NaN'), if(id % 10 = 1, null, 5.0)) as amount_received",
    )
    merged = sketches.merged_quantiles(sketches.quantile_sketch(rows, by=["part"]))
    found = {(r.column, r.share): r for r in sketches.ranks_of(rows, sketches.quartiles(merged)).collect()}
    assert len(found) == 4
    for (_, share), r in found.items():
        assert r.below - sketches.RANK_ERROR <= share <= r.upto + sketches.RANK_ERROR
    assert found["amount_received", 0.25].bound == 5.0
    paid = found["amount_paid", 0.75].bound
    assert paid == pytest.approx(75_000, abs=100_000 * sketches.RANK_ERROR + 1)


def test_only_what_is_asked_for_is_moved(spark, monkeypatch):
    """Order lines meet customers by way of the orders, and the order of time is made from ids and times alone."""
    from transferwatch import queries
    from transferwatch.sources import fixtures

    folder = "/root/testdata/sf0.001"
    plan = fixtures.transactions_view(spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join Inner" in line]
    assert "l_orderkey" in joins[1] and "o_custkey" in joins[2]

    seen = []
    monkeypatch.setattr(queries, "time_ordered", lambda df: seen.append(df.columns) or df.withColumn("place", df.ts))
    queries.time_order(spark, folder)
    assert seen == [["txn_id", "ts"]]
