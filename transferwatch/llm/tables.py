"""Small table helpers the operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from transferwatch.llm.arrays import tidy
from transferwatch.session import materialise

# Largest table that is sent to every executor, in rows of a few numbers each.
BROADCAST_ROWS = 200_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def narrow(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns only, whatever else a table holds."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


def written_and_counted(df: DataFrame) -> tuple[DataFrame, int]:
    table = materialise(df)
    return table, table.count()


def small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` to be broadcast if its counted ``rows`` allow it; else Spark shuffles it."""
    return F.broadcast(df) if rows <= limit else df


def dense_sums(
    df: DataFrame,
    count: Callable[[Iterator[pa.RecordBatch]], dict[str, np.ndarray] | Iterator[dict[str, np.ndarray]]],
    chunk: int = 4096,
) -> DataFrame:
    """Add up large arrays of counts over all tasks.

    ``count`` makes from a task's batches named arrays of numbers, all at once or some at a time. Each
    is cut into pieces of ``chunk`` numbers; equal pieces of all tasks meet in one task, which adds them one by one.
    Returns ``(name, piece, total array<double>)``; pieces nowhere above zero are left out.
    """

    def emit(batches):
        counted = count(batches)
        for arrays in [counted] if isinstance(counted, dict) else counted:
            yield from cut(arrays)

    def cut(arrays):
        names, pieces, values = [], [], []
        for name, array in arrays.items():
            for piece in range(0, len(array), chunk):
                part = np.asarray(array[piece : piece + chunk], dtype=np.float64)
                if part.any():
                    names.append(name)
                    pieces.append(piece // chunk)
                    values.append(part)
        for i in range(0, len(names), 64):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(names[i : i + 64], pa.string()),
                    pa.array(pieces[i : i + 64], pa.int64()),
                    pa.array(values[i : i + 64], pa.list_(pa.float64())),
                ],
                ["name", "piece", "part"],
            )

    parts = df.mapInArrow(tidy(emit), "name string, piece long, part array<double>")
    def add(batches):
        total: dict[tuple[str, int], np.ndarray] = {}
        for batch in batches:
            lists = batch.column("part")
            flat, at = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            for i, key in enumerate(
                zip(batch.column("name").to_pylist(), batch.column("piece").to_pylist(), strict=True)
            ):
                part = flat[at[i] - at[0] : at[i + 1] - at[0]]
                total[key] = total[key] + part if key in total else part.copy()
        if total:
            keys = list(total)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([k[0] for k in keys], pa.string()),
                    pa.array([k[1] for k in keys], pa.int64()),
                    pa.array([total[k] for k in keys], pa.list_(pa.float64())),
                ],
                ["name", "piece", "total"],
            )

    return parts.repartition("name", "piece").mapInArrow(tidy(add), "name string, piece long, total array<double>")


def gather(sums: DataFrame, sizes: dict[str, int], chunk: int = 4096) -> dict[str, np.ndarray]:
    """The arrays of ``dense_sums`` on the driver; their sizes are parameters, not the data's."""
    out = {name: np.zeros(size) for name, size in sizes.items()}
    for row in sums.toLocalIterator():
        part = np.asarray(row["total"])
        out[row["name"]][row["piece"] * chunk : row["piece"] * chunk + len(part)] = part
    return out


def gather_named(sums: DataFrame, size: int, chunk: int = 4096) -> dict[str, np.ndarray]:
    """As ``gather``, for names found in the data; the caller has checked how many there are."""
    out: dict[str, np.ndarray] = {}
    for row in sums.toLocalIterator():
        array = out.setdefault(row["name"], np.zeros(size))
        part = np.asarray(row["total"])
        array[row["piece"] * chunk : row["piece"] * chunk + len(part)] = part
    return out


def ranked(df: DataFrame, order: list[str], within: str | None = None, rank: str = "_rank") -> DataFrame:
    """Add each row's rank from 0 in the whole order, or within each value of ``within``.

    A range-partitioned sort spreads even one value's rows over many tasks. Its result is written
    once, so that a repeated task cannot change places; the rank is a row's place in its partition
    plus the rows of the partitions before, one number per partition and value.
    """
    keys = [within, *order] if within else order
    placed = materialise(
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_place", F.monotonically_increasing_id())
    )
    group = [within] if within else []
    pieces = placed.groupBy(*group, "_part").agg(
        F.min("_place").alias("_first"), F.count("*").alias("_n")
    )
    before = W.partitionBy(*group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    pieces, size = written_and_counted(
        pieces.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    )
    match = F.col("_part") == F.col("_piece")
    if within:
        pieces = pieces.withColumnRenamed(within, "_value")
        match &= F.col(within).eqNullSafe(F.col("_value"))
    joined = placed.join(small(pieces.withColumnRenamed("_part", "_piece"), size), match)
    out = joined.withColumn(rank, F.col("_place") - F.col("_first") + F.col("_before"))
    return out.select(*df.columns, rank)
