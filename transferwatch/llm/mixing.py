"""Mixing sources to target weights by Pfair scheduling, with SQL functions only on the rows.

Each source's rows are dealt into blocks. With weights ``w`` that add up to 1, block ``i`` of a
source is released at slot ``floor(i / w)`` and due by ``ceil((i + 1) / w)``; of the released blocks
the earliest due one takes the next slot. Every block then lies in its window, so at every slot
each source has had less than one block more or fewer than its weight asks for.

Weights are whole numbers that add up to a period, so one period of the schedule holds for all: it
is worked out once from the weights, and a block's slot follows from its number by arithmetic. When
a source has given its last block, a new phase starts with the weights of those that are left. No
row is dropped or repeated.

Defined results: a null source is a source of its own. Rows without text or id count like others;
repeated rows keep their number. An empty table gives no rows. Other columns play no part.
"""

from __future__ import annotations

import heapq
import math

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from transferwatch.llm.tables import ranked, small, written_and_counted
from transferwatch.session import materialise

BLOCK_ROWS = 16
# Sources a mixture may name: the plan that is broadcast has fewer numbers than ``4 * n * n``.
MAX_SOURCES = 500
# Slots of a period for each source, at least.
PERIOD = 1000
# Default target: weights in proportion to a source's rows to this power.
TEMPERATURE = 0.5

_PLAN = "_key string, phase int, _from long, _to long, _weight long, _period long, _slot long, _row long, _places array<long>"


def whole_weights(targets: dict[str, float], period: int) -> dict[str, int]:
    """Whole numbers of at least 1 in proportion to the targets that add up to ``period``."""
    total = sum(targets.values())
    exact = {s: w * period / total for s, w in targets.items()}
    out = {s: max(1, math.floor(w)) for s, w in exact.items()}
    by_need = sorted(targets, key=lambda s: (out[s] - exact[s], s))
    step = 0
    while (left := period - sum(out.values())) > 0:
        out[by_need[step % len(by_need)]] += 1
        step += 1
    for s in sorted(targets, key=lambda s: (exact[s] - out[s], s)):
        take = min(-left, out[s] - 1) if left < 0 else 0
        out[s] -= take
        left += take
    return out


def window(block: int, weight: int, period: int) -> tuple[int, int]:
    """Release and deadline of a source's block."""
    return block * period // weight, -(-(block + 1) * period // weight)


def one_period(weights: dict[str, int]) -> dict[str, list[int]]:
    """The slots of each source's blocks within a period: earliest deadline first."""
    period = sum(weights.values())
    waiting = [(0, s, 0) for s in sorted(weights)]
    ready: list[tuple[int, str, int]] = []
    places: dict[str, list[int]] = {s: [] for s in weights}
    heapq.heapify(waiting)
    for slot in range(period):
        while waiting and waiting[0][0] <= slot:
            _, s, block = heapq.heappop(waiting)
            heapq.heappush(ready, (window(block, weights[s], period)[1], s, block))
        _, s, block = heapq.heappop(ready)
        places[s].append(slot)
        if block + 1 < weights[s]:
            release = window(block + 1, weights[s], period)[0]
            heapq.heappush(waiting, (release, s, block + 1))
    return places


def phases(rows: dict[str, int], weights: dict[str, int], block_rows: int) -> list[tuple]:
    """One entry per phase and source: which of its blocks fall into the phase, and where."""
    left = {s: -(-n // block_rows) for s, n in rows.items() if n}
    done = dict.fromkeys(left, 0)
    slot = row = 0
    out = []
    for phase in range(len(left)):
        active = {s: weights[s] for s in sorted(left)}
        if not active:
            break
        period, places = sum(active.values()), one_period(active)

        def last_slot(s, period=period, places=places, active=active):
            turns, place = divmod(left[s] - 1, active[s])
            return turns * period + places[s][place]

        ended = min(active, key=lambda s: (last_slot(s), s))
        length = last_slot(ended) + 1
        turns, rest = divmod(length, period)
        used = {s: turns * active[s] + sum(p < rest for p in places[s]) for s in active}
        for s in active:
            out.append((s, phase, done[s], done[s] + used[s], active[s], period, slot, row, places[s]))
        for s in active:
            done[s] += used[s]
            left[s] -= used[s]
        missing = done[ended] * block_rows - rows[ended]
        row += length * block_rows - missing
        slot += length
        del left[ended]
    return out


def mix(
    rows: DataFrame,
    by: str = "source",
    targets: dict[str, float] | None = None,
    block_rows: int = BLOCK_ROWS,
    order: tuple[str, ...] = ("doc_id",),
    max_sources: int = MAX_SOURCES,
) -> DataFrame:
    """``rows`` with ``block, phase, release, deadline, slot, position`` of the mixture.

    ``position`` counts the mixture's rows from 0. Within a source, rows come in an order fixed by
    hashed ``order`` columns. ``targets`` gives a weight for each value of ``by``; without it, a
    source's weight is its number of rows to the power ``TEMPERATURE``.
    """
    spark = rows.sparkSession
    key = F.coalesce(F.concat(F.lit("="), F.col(f"`{by}`").cast("string")), F.lit(""))
    keyed = rows.withColumn("_key", key).withColumn("_hash", F.xxhash64(*order))
    counts = keyed.groupBy("_key").count().limit(max_sources + 1).collect()
    if len(counts) > max_sources:
        raise ValueError(f"more than {max_sources} sources to mix")
    counts = {r["_key"]: r["count"] for r in counts}
    if targets is None:
        wanted = {s: n**TEMPERATURE for s, n in counts.items()}
    else:
        missing = [s for s in counts if s[1:] not in targets]
        if missing:
            raise ValueError(f"no target weight for {missing}")
        wanted = {s: targets[s[1:]] for s in counts}
    weights = whole_weights(wanted, max(PERIOD, 4 * len(counts))) if counts else {}
    plan = F.broadcast(plan_table(spark, phases(counts, weights, block_rows)))
    placed = ranked(keyed, ["_hash", *order], within="_key")
    block = F.expr(f"_rank div {block_rows}")
    plan = plan.withColumnRenamed("_key", "_source")
    inside = (F.col("_key") == F.col("_source")) & (block >= F.col("_from")) & (block < F.col("_to"))
    number = F.expr(f"_rank div {block_rows} - _from")
    turn = F.expr(f"(_rank div {block_rows} - _from) div _weight")
    place = F.element_at("_places", (F.pmod(number, F.col("_weight")) + 1).cast("int"))
    return (
        placed.join(plan, inside)
        .withColumn("_number", number)
        .withColumn("_in_phase", turn * F.col("_period") + place)
        .select(
            *rows.columns,
            block.alias("block"),
            "phase",
            F.expr("_slot + _number * _period div _weight").alias("release"),
            F.expr("_slot + ((_number + 1) * _period + _weight - 1) div _weight").alias("deadline"),
            (F.col("_slot") + F.col("_in_phase")).alias("slot"),
            (F.col("_row") + F.col("_in_phase") * block_rows + F.col("_rank") % block_rows).alias("position"),
        )
    )


def plan_table(spark: SparkSession, entries: list[tuple]) -> DataFrame:
    return spark.createDataFrame(entries, _PLAN)


def in_mixture_order(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with the same columns, its files and rows in the order of the mixture."""
    renamed = docs.toDF(*[f"_c{i}" for i in range(len(docs.columns))])
    names = dict(zip(docs.columns, renamed.columns, strict=True))
    by = names[options.pop("by", "source")]
    order = tuple(names[c] for c in options.pop("order", ("doc_id",)))
    mixed = materialise(mix(renamed, by=by, order=order, **options).select(*renamed.columns, "position"))
    ordered = mixed.repartitionByRange("position").sortWithinPartitions("position")
    return ordered.select(*[F.col(new).alias(old) for old, new in names.items()])


def with_positions(docs: DataFrame, name: str = "position") -> DataFrame:
    """``docs``, read from files, with each row's place from 0 in the order in which the files were written.

    A written table keeps the order of its partitions in its files' numbers and that of rows in the files;
    reading it again mixes them up. A table that was not read from files has no order: null.
    """
    try:
        placed = docs.select(
            "*",
            F.col("_metadata.file_path").alias("_mixed_file"),
            F.col("_metadata.row_index").alias("_mixed_row"),
        )
    except AnalysisException:
        return docs.withColumn(name, F.lit(None).cast("long"))
    number = F.regexp_extract("_mixed_file", r"part-(\d+)[^/]*$", 1).try_cast("long")
    sizes = placed.groupBy("_mixed_file").agg((F.max("_mixed_row") + 1).alias("_n"))
    before = W.orderBy(number, "_mixed_file").rowsBetween(W.unboundedPreceding, -1)  # one row per file
    starts, files = written_and_counted(
        sizes.select("_mixed_file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_mixed_start"))
    )
    joined = placed.join(small(starts, files), "_mixed_file", "left")
    place = F.col("_mixed_start") + F.col("_mixed_row")
    return joined.withColumn(name, place).select(*docs.columns, name)
