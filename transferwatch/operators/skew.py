"""Keeping every task's share of a key bounded.

A window over an account sorts that account's rows in one task. That is right for ordinary
accounts and wrong for one that holds a large part of all rows. Here such hot keys are found,
their rows are ranked by a distributed sort, and the ranks are cut into runs of fixed length, so
that windows and joins work on ``(key, run)`` instead of ``key``. Nothing is dropped or estimated.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from transferwatch.session import materialise

# Rows of one key that a single task may sort.
MAX_GROUP_ROWS = 2_000_000
# Largest side that is broadcast.
MAX_BROADCAST_ROWS = 200_000
# Pieces a shuffled lookup spreads each key over.
SALTS = 64

RUN = "_run"
RANK = "_rank"
CARRIED = "_carried"


def hot_keys(df: DataFrame, key: str, max_group_rows: int = MAX_GROUP_ROWS) -> DataFrame | None:
    """Values of ``key`` (null included) whose rows are too many for one task, or None.

    Counts are combined before they are shuffled. The limit does not grow with the data, so the
    list may; it is a written table, and joined by its size.
    """
    counts = df.groupBy(key).agg(F.count("*").alias("n"))
    hot = materialise(counts.where(F.col("n") > max_group_rows).select(key))
    return None if hot.isEmpty() else hot


def by_size(table: DataFrame, max_broadcast_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """``table``, marked to be broadcast if it is small enough. Counts it: give a written table."""
    return F.broadcast(table) if table.count() <= max_broadcast_rows else table


def split_hot(
    df: DataFrame, key: str, hot: DataFrame | None
) -> tuple[DataFrame, DataFrame | None]:
    """Rows of ordinary keys, and rows of the keys in ``hot`` (None when there are none)."""
    if hot is None:
        return df, None
    hot = by_size(hot).withColumnRenamed(key, "_hot")
    match = F.col(key).eqNullSafe(F.col("_hot"))
    return df.join(hot, match, "left_anti"), df.join(hot, match, "left_semi")


def ranked_runs(df: DataFrame, key: str, order: list[str], run_rows: int) -> DataFrame:
    """Add each row's rank within its key and the run of ``run_rows`` ranks it falls into.

    The sort is range partitioned on a unique key, so a hot key covers many partitions. It is
    written once: partition numbers and positions must not change if a task is repeated.
    """
    ordered = materialise(
        df.orderBy(key, *order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_pos", F.monotonically_increasing_id())
    )
    # One row per (key, partition): no more than partitions plus hot keys.
    pieces = ordered.groupBy(F.col(key).alias("_key"), F.col("_part").alias("_piece")).agg(
        F.min("_pos").alias("_first"), F.count("*").alias("_n")
    )
    before = W.partitionBy("_key").orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)
    pieces = materialise(pieces.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))))
    match = (F.col("_part") == F.col("_piece")) & F.col(key).eqNullSafe(F.col("_key"))
    rank = F.col("_pos") - F.col("_first") + F.col("_before")
    return (
        ordered.join(by_size(pieces), match)
        .withColumn(RANK, rank)
        .withColumn(RUN, F.floor(F.col(RANK) / F.lit(run_rows)))
        .drop("_part", "_pos", "_key", "_piece", "_first", "_n", "_before")
    )


def with_overlap(runs: DataFrame, overlap: int, run_rows: int) -> DataFrame:
    """Also put the last ``overlap`` rows of each run in front of the next one, marked as carried.

    Every run but a key's last is full, so one run back is far enough while ``overlap`` fits in it.
    """
    if overlap > run_rows:
        raise ValueError(f"runs of {run_rows} rows cannot lend {overlap} rows to the next")
    tail = F.col(RANK) % run_rows >= run_rows - overlap
    copies = F.when(tail, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    return runs.withColumn(CARRIED, F.explode(copies)).withColumn(
        RUN, F.col(RUN) + F.col(CARRIED).cast("long")
    )


def same(left: DataFrame, right: DataFrame, columns: list[str]) -> Column:
    """Null-safe equality on all of ``columns``: a missing part is a value like any other."""
    return reduce(lambda a, b: a & b, [left[c].eqNullSafe(right[c]) for c in columns])


def join_same(
    left: DataFrame, right: DataFrame, columns: list[str], how: str = "left"
) -> DataFrame:
    """Equi-join in which nulls match nulls; the key columns come from the left."""
    names = {c: f"_r_{c}" for c in columns}
    renamed = right.withColumnsRenamed(names)
    match = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(r)) for c, r in names.items()])
    return left.join(renamed, match, how).drop(*names.values())


def spread_join(rows: DataFrame, table: DataFrame, keys: list[str], spread: str) -> DataFrame:
    """Left join to a table with one row per ``keys``, however uneven the keys of ``rows`` are.

    ``spread`` names a column that already cuts the rows of each key into bounded pieces. The
    table is first joined to the distinct ``(keys, spread)``, then the rows join on both.
    """
    pieces = join_same(rows.select(*keys, spread).distinct(), table, keys)
    return join_same(rows, pieces, [*keys, spread])


def lookup_join(
    rows: DataFrame,
    table: DataFrame,
    keys: list[str],
    table_rows: int | None = None,
    unique: str = "txn_id",
    max_broadcast_rows: int = MAX_BROADCAST_ROWS,
) -> DataFrame:
    """Left join to a table with one row per ``keys``.

    The table is counted first (``table_rows`` saves that). Up to ``max_broadcast_rows`` it is
    broadcast and the rows stay where they are; beyond, both sides are shuffled with the rows of
    each key spread over ``SALTS`` pieces.
    """
    if table_rows is None:
        table = materialise(table)
        table_rows = table.count()
    if table_rows <= max_broadcast_rows:
        return join_same(rows, F.broadcast(table), keys)
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(unique), F.lit(SALTS)))
    return spread_join(salted, table, keys, "_salt").drop("_salt")
