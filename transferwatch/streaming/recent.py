"""The latest rows of a stream in two keyed stages: a few per piece, merged into one list."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from transferwatch.operators.monitoring import RECENT
from transferwatch.session import carried_along
from transferwatch.streaming.velocity import require_rocksdb

# Pieces whose latest rows are kept apart, before one task merges them.
PIECES = 16

_COLUMNS = ["micros", "id", "value"]


class Latest(StatefulProcessor):
    """Keeps the latest rows it has seen, and gives out either those that are new or their mean."""

    def __init__(self, rows: int, mean: bool):
        self.rows, self.mean = rows, mean

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState(
            "latest", "micros array<bigint>, ids array<bigint>, vals array<double>, seen bigint"
        )

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        arrived = pd.concat([part[_COLUMNS] for part in rows], ignore_index=True).assign(new=True)
        micros, ids, values, seen = self.kept.get() or ([], [], [], 0)
        before = pd.DataFrame({"micros": micros, "id": ids, "value": values}).assign(new=False)
        both = pd.concat([before, arrived], ignore_index=True) if len(before) else arrived
        latest = both.sort_values(["micros", "id"], ascending=False, kind="stable").head(self.rows)
        step = int(seen) + 1
        self.kept.update(
            (
                [int(m) for m in latest["micros"]],
                [int(i) for i in latest["id"]],
                [None if pd.isna(v) else float(v) for v in latest["value"]],
                step,
            )
        )
        if self.mean:
            mean = latest["value"].mean()
            average = 0.0 if pd.isna(mean) else float(mean)
            yield pd.DataFrame({"step": [step], "n_recent": [len(latest)], "average": [average]})
        else:
            yield latest.loc[latest["new"].astype(bool), _COLUMNS]

    def close(self) -> None:
        pass


def stream_recent_average(
    stream: DataFrame, value: str, time: str = "ts", unique: str = "event_id", rows: int = RECENT
) -> DataFrame:
    """``(step, n_recent, average_<value>)`` after each micro-batch: the mean over the latest rows so far.

    The highest ``step`` is the last word. The order in which rows come does not matter, and late ones count
    if they are among the latest. Each piece keeps at most ``rows`` rows and passes on those that are
    new among them, so the task that merges gets ``PIECES * rows`` rows of a micro-batch at most. Rows without
    a time are older than all others. ``unique`` is a whole number. Call ``use_rocksdb`` first.
    """
    require_rocksdb(stream.sparkSession)
    listed = T.StructType().add("micros", "long").add("id", "long").add("value", "double")
    mean = T.StructType().add("step", "long").add("n_recent", "long").add("average", "double")
    narrow = stream.select(
        F.coalesce(F.unix_micros(time), F.lit(-(1 << 62))).alias("micros"),
        F.col(unique).cast("long").alias("id"),
        F.col(value).cast("double").alias("value"),
        F.pmod(F.xxhash64(unique), F.lit(PIECES)).alias("piece"),
    )
    options = {"outputMode": "Append", "timeMode": "None"}
    with carried_along():
        pieces = narrow.groupBy("piece").transformWithStateInPandas(
            statefulProcessor=Latest(rows, mean=False), outputStructType=listed, **options
        )
        merged = pieces.withColumn("piece", F.lit(0)).groupBy("piece").transformWithStateInPandas(
            statefulProcessor=Latest(rows, mean=True), outputStructType=mean, **options
        )
    return merged.select("step", "n_recent", F.col("average").alias(f"average_{value}"))
