import itertools
import zlib

import pytest
from pyspark.sql import functions as F

from tests.llm.fixtures import empty_documents, odd_documents
from transferwatch.llm import sharding
from transferwatch.llm.queries import QUERIES


@pytest.mark.parametrize("dimensions, bits", [(2, 4), (3, 3), (4, 2)])
def test_curve_goes_from_neighbour_to_neighbour(spark, dimensions, bits):
    cells = list(itertools.product(range(1 << bits), repeat=dimensions))
    frame = spark.createDataFrame(cells, ", ".join(f"c{i} int" for i in range(dimensions)))
    index = sharding.curve_index([F.col(f"c{i}") for i in range(dimensions)], bits)
    rows = frame.withColumn("at", index).orderBy("at").collect()
    assert [r.at for r in rows] == list(range(len(cells)))
    for a, b in zip(rows, rows[1:]):
        assert sum(abs(a[i] - b[i]) for i in range(dimensions)) == 1


def check_plan(rows, docs, shards):
    assert len(rows) == len(docs)
    by_shard = {}
    for row in rows:
        by_shard.setdefault(row.shard, []).append(row.slot)
    counts = [len(by_shard.get(i, [])) for i in range(shards)]
    assert max(counts) - min(counts) <= 1
    assert all(sorted(slots) == list(range(len(slots))) for slots in by_shard.values())
    ordered = sorted(rows, key=lambda r: (r.shard, r.slot))
    assert [r.curve for r in ordered] == sorted(r.curve for r in rows)


def test_query_obeys_its_law(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    rows = QUERIES["op6_hilbert_shards"](spark, "/root/testdata/sf0.01").collect()
    check_plan(rows, docs, 40)
    for row in rows:
        raw = docs[row.doc_id].encode()
        assert (row.size, row.text_crc32) == (len(raw) + 16, zlib.crc32(raw))
        assert row.law == "rows" and row.grown_shard is None


def test_odd_cases(spark):
    docs = odd_documents(spark)
    rows = sharding.shard_plan(docs, 4).collect()
    check_plan(rows, docs.collect(), 4)
    assert {(r.size, r.text_crc32) for r in rows if r.doc_id in (1, 2)} == {(16, 0)}
    assert sharding.shard_plan(empty_documents(spark)).count() == 0


def test_shards_can_be_pruned(spark, tmp_path):
    """A file of the written shards covers few of the cells."""
    docs = spark.range(4096).selectExpr("id", "id % 64 as x", "id div 64 as y")
    sharding.write_shards(docs, f"{tmp_path}/out", [F.col("x"), F.col("y")], 16)
    boxes = (
        spark.read.parquet(f"{tmp_path}/out")
        .groupBy(F.input_file_name())
        .agg(F.max("x") - F.min("x"), F.max("y") - F.min("y"), F.count("*"))
        .collect()
    )
    assert sum(r[3] for r in boxes) == 4096
    assert sum((r[1] + 1) * (r[2] + 1) for r in boxes) < 2.5 * 4096
