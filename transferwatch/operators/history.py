"""What an account did before, and its totals: windows over one side of the transfers.

All windows of a side run on one shuffle by that side's account. Accounts too large for one task
take the route of :mod:`transferwatch.operators.skew` and give the same values.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F

from transferwatch.functions import epoch_seconds, or_zero, ratio, share
from transferwatch.operators.skew import (
    CARRIED,
    MAX_GROUP_ROWS,
    RANK,
    RUN,
    by_size,
    hot_keys,
    join_same,
    ranked_runs,
    split_hot,
    spread_join,
    with_overlap,
)
from transferwatch.schema import AMOUNTS, ID, LABEL, SENDER, TIME, Side
from transferwatch.session import materialise

# Fixed values.
ROLLING_ROWS = 5
UNIQUE_ROWS = 20
VELOCITY_SECONDS = 3600
RATIO_EPSILON = 1e-6
NO_PREVIOUS = -1.0

SECOND = "_sec"
ORDER = [SECOND, TIME, ID]

# What can be asked for.
RECENCY = "recency"
ROLLING_STD = "rolling_std"
ROLLING_MEAN = "rolling_mean"
MEAN_RATIO = "mean_ratio"
ROLLING_UNIQUE = "rolling_unique"
VELOCITY = "velocity"
TOTALS = "totals"
FRAUD_RATE = "fraud_rate"
UNIQUE_OTHERS = "unique_others"
PAIR_COUNT = "pair_count"
FORMAT_COUNT = "format_count"

HISTORY = (RECENCY, ROLLING_STD, ROLLING_MEAN, MEAN_RATIO, ROLLING_UNIQUE, VELOCITY)
COUNTS = (TOTALS, FRAUD_RATE, UNIQUE_OTHERS, PAIR_COUNT, FORMAT_COUNT)

# Columns that hold raw counts until the caller turns them into shares.
PAIR_ROWS = "account_pair_rows"
FORMAT_ROWS = "sender_payment_format_rows"


def side_features(
    df: DataFrame,
    side: Side,
    wanted: Iterable[str],
    label: str = LABEL,
    lookup: DataFrame | None = None,
    max_group_rows: int = MAX_GROUP_ROWS,
    counted_on: DataFrame | None = None,
) -> DataFrame:
    """``df`` with the wanted features of one side.

    ``lookup`` may bring further columns per account: a table with the side's key and values.
    ``counted_on`` is a cheaper frame of the same rows on which to look for hot accounts.
    """
    wanted = set(wanted)
    hot_accounts = hot_keys(df if counted_on is None else counted_on, side.key, max_group_rows)
    if hot_accounts is not None and counted_on is not None and df is not counted_on:
        df = materialise(df)  # both branches read it: what made it must not run twice
    timed = df.withColumn(SECOND, epoch_seconds(TIME))
    ordinary, hot = split_hot(timed, side.key, hot_accounts)
    result = _ordinary(ordinary, side, wanted, label, lookup)
    if hot is not None:
        split = _hot(hot, side, wanted, label, lookup, max_group_rows)
        result = result.unionByName(split)
    return result.drop(SECOND)


def _counted(wanted: set[str], label: str) -> str:
    """What totals count: labels where labels take part, otherwise rows."""
    return label if FRAUD_RATE in wanted else "*"


def history_columns(side: Side, wanted: set[str], part: list[str]) -> dict[str, Column]:
    """Columns over the account's rows in time order, each on a short row frame."""
    ordered = W.partitionBy(*part).orderBy(*ORDER)
    known = F.col(side.key).isNotNull()
    columns: dict[str, Column] = {}
    if RECENCY in wanted:
        micros = F.unix_micros(TIME)
        gap = (micros - F.lag(micros).over(ordered)) / F.lit(1e6)
        columns[f"time_since_last_txn_{side.name}"] = F.coalesce(
            F.when(known, gap), F.lit(NO_PREVIOUS)
        )
    last_rows = ordered.rowsBetween(1 - ROLLING_ROWS, 0)
    for amount in AMOUNTS:
        mean = F.when(known, F.avg(amount).over(last_rows))
        if ROLLING_STD in wanted:
            deviation = F.stddev_samp(amount).over(last_rows)
            columns[f"rolling_std_{amount}_{side.name}"] = F.when(known, or_zero(deviation))
        if ROLLING_MEAN in wanted:
            columns[f"rolling_avg_{amount}_{side.name}"] = mean
        if MEAN_RATIO in wanted:
            columns[f"{amount}_to_avg_{side.name}_ratio"] = ratio(amount, mean, RATIO_EPSILON)
    if ROLLING_UNIQUE in wanted and side == SENDER:
        recent = ordered.rowsBetween(1 - UNIQUE_ROWS, 0)
        # A missing receiver is one more value; a set leaves it out.
        missing = F.max(F.col(side.other).isNull().cast("int")).over(recent)
        distinct = F.size(F.collect_set(side.other).over(recent)) + missing
        columns["rolling_unique_receivers_sender"] = F.when(known, distinct).cast("long")
    return columns


def _last_hour(spec: WindowSpec, rows: Column) -> Column:
    """``rows`` summed over the last hour, as the difference of two running sums.

    Running sums move forward only, so the work is linear; a sliding hour would be re-added
    for every row.
    """
    now = rows.over(spec.rangeBetween(W.unboundedPreceding, 0))
    before = rows.over(spec.rangeBetween(W.unboundedPreceding, -VELOCITY_SECONDS - 1))
    return now - F.coalesce(before, F.lit(0))


def _ordinary(
    df: DataFrame, side: Side, wanted: set[str], label: str, lookup: DataFrame | None
) -> DataFrame:
    key = side.key
    known = F.col(key).isNotNull()
    result = df.withColumns(history_columns(side, wanted, [key]))
    if VELOCITY in wanted:
        by_second = W.partitionBy(key).orderBy(SECOND)
        hour = _last_hour(by_second, F.count("*"))
        result = result.withColumn(f"txn_velocity_{side.name}", F.when(known, hour))

    whole = W.partitionBy(key)
    totals: dict[str, Column] = {}
    if TOTALS in wanted:
        totals[f"{side.name}_total_txn"] = F.when(known, F.count(_counted(wanted, label)).over(whole))
        totals[f"{side.name}_rows"] = F.when(known, F.count("*").over(whole))
    if FRAUD_RATE in wanted:
        rate = F.avg(F.col(label).cast("double")).over(whole)
        totals[f"{side.name}_fraud_rate"] = F.when(known, rate)
    result = result.withColumns(totals)

    # These two share one sort by (account, other account).
    if UNIQUE_OTHERS in wanted:
        place = F.dense_rank().over(W.partitionBy(key).orderBy(side.other))
        gap = F.max(F.col(side.other).isNull().cast("int")).over(whole)
        result = result.withColumn("_place", place)
        distinct = (F.max("_place").over(whole) - gap).cast("long")
        result = result.withColumn(side.unique_others, F.when(known, distinct)).drop("_place")
    if PAIR_COUNT in wanted:
        pair = W.partitionBy(key, side.other)
        result = result.withColumn(PAIR_ROWS, F.count("*").over(pair))
    if FORMAT_COUNT in wanted:
        by_format = W.partitionBy(key, "payment_format")
        result = result.withColumn(FORMAT_ROWS, F.count("*").over(by_format))
    if lookup is not None:
        result = result.join(lookup, key, "left")
    return result


def _hot(
    df: DataFrame,
    side: Side,
    wanted: set[str],
    label: str,
    lookup: DataFrame | None,
    run_rows: int,
) -> DataFrame:
    key = side.key
    known = F.col(key).isNotNull()
    run_rows = max(run_rows, UNIQUE_ROWS - 1)  # a run lends that many rows to the next
    runs = ranked_runs(df, key, ORDER, run_rows)
    result = runs
    if wanted & set(HISTORY) - {VELOCITY}:
        lent = with_overlap(runs, UNIQUE_ROWS - 1, run_rows)
        windows = lent.withColumns(history_columns(side, wanted, [key, RUN]))
        result = windows.where(~F.col(CARRIED)).drop(CARRIED)
    if VELOCITY in wanted:
        name = f"txn_velocity_{side.name}"
        velocity = _velocity_by_second(runs, key, name)
        result = spread_join(result, velocity, [key, SECOND], RUN)
        result = result.withColumn(name, F.when(known, F.col(name)))

    # One row per hot key, so these tables are as small as the list of hot keys.
    per_key = runs.groupBy(key).agg(
        F.count(_counted(wanted, label)).alias("_total"),
        F.count("*").alias("_rows"),
        F.avg(F.col(label).cast("double")).alias("_rate")
        if FRAUD_RATE in wanted
        else F.lit(None).cast("double").alias("_rate"),
    )
    totals: dict[str, Column] = {}
    if TOTALS in wanted:
        totals[f"{side.name}_total_txn"] = F.when(known, F.col("_total"))
        totals[f"{side.name}_rows"] = F.when(known, F.col("_rows"))
    if FRAUD_RATE in wanted:
        totals[f"{side.name}_fraud_rate"] = F.when(known, F.col("_rate"))
    if totals:
        result = join_same(result, by_size(materialise(per_key)), [key])
        result = result.withColumns(totals).drop("_total", "_rows", "_rate")
    if UNIQUE_OTHERS in wanted:
        others = (
            runs.select(key, side.other)
            .distinct()
            .groupBy(key)
            .agg(F.count(side.other).alias(side.unique_others))
        )
        result = join_same(result, by_size(materialise(others)), [key])
        result = result.withColumn(side.unique_others, F.when(known, F.col(side.unique_others)))
    if PAIR_COUNT in wanted:
        pairs = runs.groupBy(key, side.other).agg(F.count("*").alias(PAIR_ROWS))
        result = spread_join(result, pairs, [key, side.other], RUN)
    if FORMAT_COUNT in wanted:
        formats = runs.groupBy(key, "payment_format").agg(F.count("*").alias(FORMAT_ROWS))
        result = spread_join(result, formats, [key, "payment_format"], RUN)
    if lookup is not None:
        known_keys = by_size(materialise(runs.select(key).distinct()))
        hot_lookup = materialise(lookup.join(known_keys, key, "left_semi"))
        result = spread_join(result, hot_lookup, [key], RUN)
    return result.drop(RANK, RUN)


def _velocity_by_second(runs: DataFrame, key: str, name: str) -> DataFrame:
    """Rows of the last hour for each second of each hot key.

    Rows are first counted per second. A second is needed in its own hour and the next, so
    a group holds two hours: at most 7,200 rows however busy the account is.
    """
    hour = F.floor(F.col(SECOND) / VELOCITY_SECONDS)
    per_second = runs.groupBy(key, SECOND).agg(F.count("*").alias("_n"))
    twice = per_second.withColumn("_hour", F.explode(F.array(hour, hour + 1)))
    by_second = W.partitionBy(key, "_hour").orderBy(SECOND)
    return (
        twice.withColumn(name, _last_hour(by_second, F.sum("_n")))
        .where(F.col("_hour") == hour)
        .select(key, SECOND, name)
    )


def velocity(df: DataFrame, side: Side, **options) -> DataFrame:
    """Rows of the same account in ``[t - 3600 s, t]``, equal times and the row itself included."""
    return side_features(df, side, [VELOCITY], **options)


def recency(df: DataFrame, side: Side, **options) -> DataFrame:
    """Seconds since the account's previous transfer; -1 for its first."""
    return side_features(df, side, [RECENCY], **options)


def account_totals(df: DataFrame, side: Side, label: str | None = LABEL, **options) -> DataFrame:
    """Transfers of the account and, with a label, the share of them that is laundering."""
    wanted = [TOTALS] if label is None else [TOTALS, FRAUD_RATE]
    found = side_features(df, side, wanted, label=label or LABEL, **options)
    return found.drop(f"{side.name}_rows")


def unique_counterparties(df: DataFrame, side: Side, **options) -> DataFrame:
    """How many different accounts stand at the far end of the account's transfers."""
    return side_features(df, side, [UNIQUE_OTHERS], **options)


def account_frequency(df: DataFrame, side: Side, total: Column, **options) -> DataFrame:
    """The account's share of the rows in ``total``."""
    counted = side_features(df, side, [TOTALS], **options)
    rows = f"{side.name}_rows"
    return counted.withColumn(f"{side.key}_freq_enc", share(F.col(rows), total)).drop(rows)

