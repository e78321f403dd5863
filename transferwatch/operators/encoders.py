"""Frequency, target and one-hot encodings of low-cardinality columns and their combinations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from transferwatch.functions import as_flag, calendar_parts, share
from transferwatch.operators.history import (
    FORMAT_COUNT,
    FORMAT_ROWS,
    PAIR_COUNT,
    PAIR_ROWS,
    side_features,
)
from transferwatch.operators.skew import MAX_GROUP_ROWS, lookup_join
from transferwatch.schema import LABEL, ONE_HOT, SENDER, TIME

# Combinations whose frequency is a feature, by feature name.
INTERACTIONS = {
    "bank_pair_freq_enc": ["from_bank", "to_bank"],
    "account_pair_freq_enc": ["account", "account_1"],
    "payment_format_hour_freq_enc": ["payment_format", "hour"],
    "sender_payment_format_freq_enc": ["account", "payment_format"],
    "day_hour_freq_enc": ["day", "hour"],
    "bank_payment_hour_freq_enc": ["from_bank", "payment_format", "hour"],
}


def with_calendar(df: DataFrame) -> DataFrame:
    return df.withColumns(calendar_parts(TIME))


def row_total(df: DataFrame, column: str | None = None) -> DataFrame:
    """Number of rows (in which ``column`` is present), as a one-row table."""
    return df.agg(F.count(column if column else "*").alias("_total"))


def with_total(df: DataFrame, total: DataFrame) -> DataFrame:
    """Attach a one-row table; the broadcast is one row."""
    return df.crossJoin(F.broadcast(total))


def frequency_table(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Share of rows per key. A single missing key is no group; a missing part of several is one."""
    single = len(keys) == 1
    rows = df.where(F.col(keys[0]).isNotNull()) if single else df
    counts = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    total = row_total(df, keys[0] if single else None)
    return with_total(counts, total).select(*keys, share(F.col("_n"), F.col("_total")).alias(name))


def target_table(df: DataFrame, key: str, name: str, label: str = LABEL) -> DataFrame:
    """Mean label per key."""
    rows = df.where(F.col(key).isNotNull())
    return rows.groupBy(key).agg(F.avg(F.col(label).cast("double")).alias(name))


def frequency_encode(df: DataFrame, keys: list[str], name: str, **options) -> DataFrame:
    """Each row's key frequency, joined back to the rows."""
    return lookup_join(df, frequency_table(df, keys, name), keys, **options)


def target_encode(
    df: DataFrame, key: str, name: str, label: str = LABEL, **options
) -> DataFrame:
    """Each row's key mean label, joined back to the rows."""
    return lookup_join(df, target_table(df, key, name, label), [key], **options)


def account_pair_frequency(df: DataFrame, max_group_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """Frequency of (sender, receiver): counted where the sender's rows already are."""
    return _sender_frequency(
        df, PAIR_COUNT, PAIR_ROWS, "account_pair_freq_enc", max_group_rows
    )


def sender_format_frequency(df: DataFrame, max_group_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """Frequency of (sender, payment format)."""
    return _sender_frequency(
        df, FORMAT_COUNT, FORMAT_ROWS, "sender_payment_format_freq_enc", max_group_rows
    )


def _sender_frequency(
    df: DataFrame, wanted: str, rows: str, name: str, max_group_rows: int
) -> DataFrame:
    counted = side_features(df, SENDER, [wanted], max_group_rows=max_group_rows)
    return with_total(counted, row_total(df)).withColumn(
        name, share(F.col(rows), F.col("_total"))
    ).drop(rows, "_total")


def one_hot_categories(df: DataFrame, columns: list[str] = ONE_HOT) -> dict[str, list[str]]:
    """Sorted categories of each column: as many as there are, each of them a column later."""
    categories = {}
    for column in columns:
        values = df.select(column).where(F.col(column).isNotNull()).distinct()
        categories[column] = sorted(r[0] for r in values.collect())
    return categories


def named_categories(categories: dict[str, list[str]]) -> dict[str, tuple[str, str]]:
    """Column and category by the name of the one-hot column, the first category left out.

    Names that Spark would take for the same, which ignores case, get a number.
    """
    named: dict[str, tuple[str, str]] = {}
    taken: set[str] = set()
    for column, values in categories.items():
        for value in values[1:]:
            name, copy = f"{column}_{value}", 1
            while name.lower() in taken:
                copy += 1
                name = f"{column}_{value}_{copy}"
            taken.add(name.lower())
            named[name] = (column, value)
    return named


def one_hot_names(categories: dict[str, list[str]]) -> list[str]:
    return list(named_categories(categories))


def one_hot_columns(categories: dict[str, list[str]]) -> dict[str, Column]:
    """One 0/1 column per category but the first; all 0 for a missing or unknown value."""
    return {
        name: as_flag(F.col(c) == F.lit(v)) for name, (c, v) in named_categories(categories).items()
    }


def one_hot(df: DataFrame, categories: dict[str, list[str]]) -> DataFrame:
    return df.withColumns(one_hot_columns(categories)).drop(*categories)
