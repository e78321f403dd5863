"""Rows in the order of time, with their place in it, as files that can be pruned by time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from transferwatch.operators.skew import by_size
from transferwatch.schema import ID, TIME
from transferwatch.session import materialise


def time_ordered(df: DataFrame, time: str = TIME, unique: str = ID, rank: str = "place") -> DataFrame:
    """``df`` with each row's place from 1 in the order of ``time``, rows without a time first, ties by ``unique``.

    Rows are dealt to tasks by ranges of (time, id), so no moment is too busy for one, sorted there and
    written once; a place is that in the range plus the rows of the ranges before, one number per range.
    """
    placed = materialise(
        df.repartitionByRange(time, unique)
        .sortWithinPartitions(time, unique)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_pos", F.monotonically_increasing_id())
    )
    parts = placed.groupBy("_part").agg(F.min("_pos").alias("_first"), F.count("*").alias("_n"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # one row per range
    starts = materialise(
        parts.select(
            F.col("_part").alias("_range"),
            "_first",
            F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        )
    )
    joined = placed.join(by_size(starts), F.col("_part") == F.col("_range"))
    place = F.col("_pos") - F.col("_first") + F.col("_before") + 1
    return joined.withColumn(rank, place).select(*df.columns, rank)


def write_time_ordered(
    df: DataFrame, path: str, time: str = TIME, unique: str = ID, files: int | None = None
) -> None:
    """Files that each hold a range of time in order: a filter on ``time`` skips the others.

    Their number is ``files`` or follows the size of the table.
    """
    number = (files,) if files else ()
    sorted_rows = df.repartitionByRange(*number, time, unique).sortWithinPartitions(time, unique)
    sorted_rows.write.mode("overwrite").parquet(path)
