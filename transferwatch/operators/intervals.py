"""Pairs of transfers of one account that lie close in time: an interval join without sliding windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transferwatch.functions import epoch_seconds
from transferwatch.operators.history import VELOCITY_SECONDS
from transferwatch.operators.skew import by_size
from transferwatch.schema import ID, TIME, Side
from transferwatch.session import materialise

# Rows of one account and bin that one task may hold before they are dealt out.
MAX_BIN_ROWS = 10_000


def interval_matches(
    df: DataFrame,
    side: Side,
    seconds: int = VELOCITY_SECONDS,
    unique: str = ID,
    time: str = TIME,
    max_bin_rows: int = MAX_BIN_ROWS,
) -> DataFrame:
    """``(unique, matched)``: each transfer with those of its account in ``[t - seconds, t]``, itself included.

    Time is cut into bins as long as the interval, so a transfer's interval touches its own bin and
    the one before: transfers that ask are put into both, those that are found into one, and an equi-join on
    (account, bin) leaves only pairs near each other for the exact comparison. Of a bin with more
    than ``max_bin_rows`` rows, the asking rows are dealt to several tasks and the others copied to
    each. Transfers without account or time match nothing, themselves included.
    """
    rows = df.where(F.col(side.key).isNotNull() & F.col(time).isNotNull()).select(
        F.col(unique).alias("id"), F.col(side.key).alias("key"), epoch_seconds(time).alias("sec")
    )
    there = F.floor(F.col("sec") / seconds)
    found = rows.withColumn("bin", there)
    asking = rows.withColumn("bin", F.explode(F.array(there - 1, there)))

    # How many tasks share the work of a large bin.
    sizes = found.groupBy("key", "bin").agg(F.ceil(F.count("*") / max_bin_rows).cast("int").alias("pieces"))
    hot = materialise(sizes.where("pieces > 1"))
    piece, whole = F.lit(0), F.array(F.lit(0))
    if not hot.isEmpty():
        table = by_size(hot)
        asking, found = (side_.join(table, ["key", "bin"], "left") for side_ in (asking, found))
        share = F.coalesce(F.col("pieces"), F.lit(1))
        piece = F.pmod(F.xxhash64("id"), share).cast("int")
        whole = F.sequence(F.lit(0), share - 1)
    left = asking.select("id", "key", "bin", "sec", piece.alias("piece"))
    right = found.select(
        F.col("id").alias("matched"), "key", "bin", F.col("sec").alias("then"), F.explode(whole).alias("piece")
    )
    near = F.col("then").between(F.col("sec") - seconds, F.col("sec"))
    return (
        left.join(right, ["key", "bin", "piece"])
        .where(near)
        .select(F.col("id").alias(unique), "matched")
    )
