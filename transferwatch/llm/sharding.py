"""Sharding along a Hilbert curve, with SQL functions only.

Several metadata dimensions are quantised to a few bits each and turned into the index of a cell on
a Hilbert curve. Rows sorted by that index are cut into runs of equal length. Neighbours on the
curve are neighbours in all dimensions, so each run covers a small box, and a reader that filters
on any dimension can leave most files out.

The curve is a table: a state (one of the ways the curve can enter and cross a cell) and the cell's
corner give the next digit of the index and the next state. The table follows from Gray codes.

Defined results: a null text counts no bytes; a null value is a level of its own. Ties are ordered
by the text's checksum and the id; rows that are equal in all of these may change places with each
other. An empty table gives no rows. Other columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from transferwatch.llm.tables import ranked
from transferwatch.session import materialise

SHARDS = 40
# Bits that each dimension is quantised to.
BITS = 6
# Fixed value: bytes every row counts beside its text.
ROW_BYTES = 16


def _gray(i: int) -> int:
    return i ^ (i >> 1)


def _trailing_ones(i: int) -> int:
    return (~i & (i + 1)).bit_length() - 1


def curve_tables(dimensions: int) -> tuple[list[int], list[int]]:
    """Digit and next state for each ``state * 2**dimensions + corner``.

    A state is the corner at which the curve enters a cell, times the dimensions, plus the
    direction along which it leaves.
    """
    n, corners = dimensions, 1 << dimensions

    def rotate(value: int, by: int) -> int:
        by %= n
        return ((value << by) | (value >> (n - by))) & (corners - 1)

    gray_to_digit = {_gray(i): i for i in range(corners)}
    digits, following = [], []
    for state in range(corners * n):
        entry, direction = divmod(state, n)
        for corner in range(corners):
            digit = gray_to_digit[rotate(corner ^ entry, n - direction - 1)]
            inner = _gray(2 * ((digit - 1) // 2)) if digit else 0
            turn = 0 if not digit else _trailing_ones(digit if digit % 2 else digit - 1) % n
            digits.append(digit)
            following.append((entry ^ rotate(inner, direction + 1)) * n + (direction + turn + 1) % n)
    return digits, following


def curve_index(levels: list[Column], bits: int = BITS) -> Column:
    """Index on the Hilbert curve of a cell given by one whole number per dimension."""
    n = len(levels)
    digits, following = (F.array(*[F.lit(v) for v in t]) for t in curve_tables(n))

    def step(state: Column, bit: Column) -> Column:
        corner = sum(
            (F.getbit(level.cast("long"), bit).cast("int") * (1 << (n - 1 - k)) for k, level in enumerate(levels)),
            F.lit(0),
        )
        at = state["state"] * (1 << n) + corner + 1
        return F.struct(
            (state["index"] * (1 << n) + F.element_at(digits, at)).alias("index"),
            F.element_at(following, at).alias("state"),
        )

    start = F.struct(F.lit(0).cast("long").alias("index"), F.lit(0).alias("state"))
    order = F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1))
    return F.aggregate(order, start, step, lambda state: state["index"])


def size_level(size: Column, bits: int = BITS) -> Column:
    """Sizes on a logarithmic scale: three levels for each doubling, from 16 bytes on."""
    level = F.floor(3 * F.log2(size / ROW_BYTES))
    return F.least(F.greatest(level, F.lit(0)), F.lit((1 << bits) - 1)).cast("int")


def value_level(value: Column, bits: int = BITS) -> Column:
    """Equal values on one level; a null is level 0."""
    return F.coalesce(F.pmod(F.crc32(value.cast("string")), F.lit(1 << bits)), F.lit(0)).cast("int")


def described(docs: DataFrame) -> DataFrame:
    """Id, size, checksum and curve index of every row of ``docs (doc_id, text, lang, source)``."""
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit(""))).alias("text_crc32"),
        value_level(F.col("source")).alias("source_level"),
        value_level(F.col("lang")).alias("lang_level"),
    )
    levels = [F.col("source_level"), F.col("lang_level"), size_level(F.col("size"))]
    return rows.withColumn("curve", curve_index(levels))


def shard_plan(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The shard and slot of every row: runs along the curve whose row counts are at most one apart."""
    rows = materialise(described(docs))
    total = rows.count()
    rank = F.col("_rank")
    shard = F.expr(f"_rank * {shards} div {max(total, 1)}")
    first = F.expr(f"(_shard * {total} + {shards - 1}) div {shards}")
    return (
        ranked(rows, ["curve", "text_crc32", "doc_id"])
        .withColumn("_shard", shard)
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("rows").alias("law"),
            F.col("_shard").cast("int").alias("shard"),
            (rank - first).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
            "curve",
        )
    )


def write_shards(docs: DataFrame, path: str, dimensions: list[Column], shards: int = SHARDS) -> None:
    """Write ``docs`` as ``shards`` files along the curve of any quantised dimensions."""
    indexed = docs.withColumn("_curve", curve_index(dimensions))
    ordered = indexed.repartitionByRange(shards, "_curve").sortWithinPartitions("_curve")
    ordered.drop("_curve").write.parquet(path)
