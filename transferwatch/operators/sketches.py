"""Mergeable sketches: distinct counterparties and amount quartiles without keeping the values.

Both are columns of bytes that can be written beside the lookups and merged over runs; merging the sketches of
parts gives the sketch of the whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from transferwatch.schema import AMOUNTS, Side

# 2**12 registers: a standard error of 1.6 %.
HLL_BITS = 12
# Three standard errors.
DISTINCT_ERROR = 3 * 1.04 / 2 ** (HLL_BITS / 2)
# A KLL sketch of this size is off by at most this share of the ranks, in 99 of 100 cases.
KLL_SIZE = 2000
RANK_ERROR = 0.0025

QUARTILES = (0.25, 0.75)


def distinct_sketch(df: DataFrame, side: Side) -> DataFrame:
    """``(account, others, transfers)``: a sketch of the accounts at the far end, and how many rows it saw."""
    known = df.where(F.col(side.key).isNotNull())
    return known.groupBy(side.key).agg(
        F.hll_sketch_agg(side.other, HLL_BITS).alias("others"), F.count("*").alias("transfers")
    )


def merged_distinct(sketches: DataFrame, side: Side) -> DataFrame:
    """Sketches of several runs as one per account."""
    return sketches.groupBy(side.key).agg(
        F.hll_union_agg("others").alias("others"), F.sum("transfers").alias("transfers")
    )


def estimated_distinct(sketches: DataFrame, side: Side) -> DataFrame:
    return sketches.select(
        side.key, F.hll_sketch_estimate("others").alias(side.unique_others), "transfers"
    )


def quantile_sketch(df: DataFrame, columns: list[str] = AMOUNTS, by: list[str] | None = None) -> DataFrame:
    """One sketch per column (named as the column), for the whole table or per group. NaN counts as missing."""
    def sketch(name: str) -> Column:
        value = F.col(name).cast("double")
        return F.kll_sketch_agg_double(F.when(~F.isnan(value), value), F.lit(KLL_SIZE)).alias(name)

    return df.groupBy(*(by or [])).agg(*[sketch(c) for c in columns])


def merged_quantiles(sketches: DataFrame, columns: list[str] = AMOUNTS) -> DataFrame:
    """Sketches of several parts as one per column."""
    return sketches.agg(*[F.kll_merge_agg_double(c).alias(c) for c in columns])


def quartiles(sketches: DataFrame, columns: list[str] = AMOUNTS) -> DataFrame:
    """``(column, share, bound)`` from the one line of :func:`merged_quantiles`."""
    rows = [
        F.struct(
            F.lit(c).alias("column"),
            F.lit(q).alias("share"),
            F.kll_sketch_get_quantile_double(c, F.lit(q)).alias("bound"),
        )
        for c in columns
        for q in QUARTILES
    ]
    return sketches.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def ranks_of(df: DataFrame, bounds: DataFrame, columns: list[str] = AMOUNTS) -> DataFrame:
    """``bounds`` with the exact shares of rows below each bound and up to it, counted in one pass."""
    asked = bounds.collect()  # two lines per column
    counts = []
    for i, r in enumerate(asked):
        value = F.col(r["column"]).cast("double")
        known = value.isNotNull() & ~F.isnan(value)
        counts += [
            F.count_if(known).alias(f"n{i}"),
            F.count_if(known & (value < r["bound"])).alias(f"below{i}"),
            F.count_if(known & (value <= r["bound"])).alias(f"upto{i}"),
        ]
    found = df.agg(*counts).first()
    rows = [
        (r["column"], r["share"], r["bound"], found[f"below{i}"] / n, found[f"upto{i}"] / n)
        for i, r in enumerate(asked)
        if (n := found[f"n{i}"])
    ]
    return df.sparkSession.createDataFrame(
        rows, "column string, share double, bound double, below double, upto double"
    )
