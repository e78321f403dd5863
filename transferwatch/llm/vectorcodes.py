"""Vector codes by member-resident Lloyd: parts live with the entry that owns them.

Vectors are cut into parts; each part position has a codebook. Every part is a row of a table dealt by
``(position, entry, salt)``. In a round each row is held against the codebook where it lies: a part
whose nearest entry is still its owner stays in its place, and only parts whose entry changed
are shuffled to their new owner. Owners then add up the members that are resident with them. The salt
cuts an entry with very many members (copies of one vector) over 64 owners, whose sums are added.

All arithmetic is in whole numbers: component ``x`` counts as ``floor(1024 * x)``. Parts are compared
through a matrix product in doubles while every intermediate result is below 2**53 and so exact;
beyond, in Python's whole numbers. Only codebooks (256 entries a position) reach the driver.

Defined cases. A vector that is null or holds null, NaN or infinite components takes no part, nor
does one whose length is not that of the first vector (smallest id). If the length is no multiple of
the number of parts, part ``i`` starts at ``i * length // parts``. Ids may repeat or be null (ordered last): every row gets
its code. Fewer rows than entries give a smaller codebook, an empty table an empty result. Ties go
to the lower entry; entries without members stay. An error beyond a long is given as the largest long.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from transferwatch.llm.arrays import tidy
from transferwatch.operators.skew import lookup_join
from transferwatch.session import delete, materialise, scratch, scratch_path

# Fixed values.
SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
# Owners that share one entry.
SALTS = 64

_LARGEST = 2**63 - 1
# Parts compared with a codebook at once.
_ROWS = 4096

_MEMBER = "position int, entry int, salt int, part array<long>"


@dataclass(frozen=True)
class Codebooks:
    """One array of entries (rows) per part position, in whole numbers."""

    tables: tuple[np.ndarray, ...]

    @property
    def bounds(self) -> list[int]:
        return [0, *np.cumsum([t.shape[1] for t in self.tables]).tolist()]

    def digest(self) -> str:
        """SHA-256 of all components in decimal, comma-joined, by part, entry and position."""
        numbers = ",".join(str(x) for t in self.tables for x in t.ravel().tolist())
        return hashlib.sha256(numbers.encode()).hexdigest()


def whole_vectors(rows: DataFrame, vector: str = "vector") -> DataFrame:
    """The rows whose vectors take part, with ``vector`` in whole numbers."""
    usable = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE))
    return rows.where(F.col(vector).isNotNull()).where(usable).withColumn(vector, whole)


def nearest_entries(parts: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each part's nearest entry (lowest of equals) and the squared distance, exactly."""
    if not len(parts):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    entries, distances = [], []
    for start in range(0, len(parts), _ROWS):
        own = parts[start : start + _ROWS]
        reach = max(_reach(own), _reach(table))
        if 4 * reach * reach * max(1, own.shape[1]) < 2**53:
            x, c = own.astype(np.float64), table.astype(np.float64)
            gap = (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)
            best = gap.argmin(1)
            least = gap[np.arange(len(own)), best].astype(np.int64)
        else:
            x, c = own.astype(object), table.astype(object)
            gaps = [((row - c) ** 2).sum(1).tolist() for row in x]
            best = np.array([g.index(min(g)) for g in gaps])
            least = np.array([min(g) for g in gaps], dtype=object)
        entries.append(best)
        distances.append(least)
    return np.concatenate(entries), np.concatenate(distances)


def _reach(numbers: np.ndarray) -> int:
    return max(abs(int(numbers.max())), abs(int(numbers.min()))) if numbers.size else 0


def _block(column: pa.ListArray, rows: np.ndarray, start: int, width: int) -> np.ndarray:
    """Components ``start`` to ``start + width`` of some rows of a list column."""
    flat = column.values.to_numpy(zero_copy_only=False)
    at = column.offsets.to_numpy()[rows] + start
    return flat[at[:, None] + np.arange(width)]


def _dealt_members(codebooks: Codebooks):
    """Cut vectors into parts with the entry nearest to each."""

    def run(batches):
        seen = 0
        for batch in batches:
            column, rows = batch.column("vector"), np.arange(batch.num_rows)
            salt = (seen + rows) % SALTS
            seen += len(rows)
            for position, table in enumerate(codebooks.tables):
                start, width = codebooks.bounds[position], table.shape[1]
                parts = _block(column, rows, start, width)
                entry, _ = nearest_entries(parts, table)
                yield _members(np.full(len(rows), position), entry, salt, list(parts))

    return tidy(run)


def _members(position, entry, salt, parts, *flags) -> pa.RecordBatch:
    columns = [pa.array(x.astype(np.int32), pa.int32()) for x in (position, entry, salt)]
    columns.append(pa.array(parts, pa.list_(pa.int64())))
    return pa.RecordBatch.from_arrays(
        [*columns, *[pa.array(f, pa.bool_()) for f in flags]],
        ["position", "entry", "salt", "part", *["moved"][: len(flags)]],
    )


def _held_against(codebooks: Codebooks):
    """Each member with its nearest entry, and whether that is a new one."""

    def run(batches):
        for batch in batches:
            position = batch.column("position").to_numpy()
            entry = batch.column("entry").to_numpy()
            now = entry.astype(np.int64)
            for p, table in enumerate(codebooks.tables):
                rows = np.flatnonzero(position == p)
                now[rows] = nearest_entries(_block(batch.column("part"), rows, 0, table.shape[1]), table)[0]
            columns = [
                batch.column("position"),
                pa.array(now.astype(np.int32)),
                batch.column("salt"),
                batch.column("part"),
                pa.array(now != entry),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["position", "entry", "salt", "part", "moved"])

    return tidy(run)


def _resident_sums(widths: list[int]):
    """Count and sum of the members of each entry in this task, numbers as text."""

    def run(batches):
        counts: dict[tuple[int, int], int] = {}
        totals: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            position = batch.column("position").to_numpy()
            entry = batch.column("entry").to_numpy()
            for p, width in enumerate(widths):
                rows = np.flatnonzero(position == p)
                rows = rows[np.argsort(entry[rows], kind="stable")]
                if not len(rows):
                    continue
                parts = _block(batch.column("part"), rows, 0, width)
                if _reach(parts) >= 2**31:
                    parts = parts.astype(object)
                owners, first = np.unique(entry[rows], return_index=True)
                sums = np.add.reduceat(parts, first, axis=0)
                for owner, n, total in zip(owners, np.diff([*first, len(rows)]), sums, strict=True):
                    key = (p, int(owner))
                    counts[key] = counts.get(key, 0) + int(n)
                    own = total.astype(object)
                    totals[key] = totals[key] + own if key in totals else own
        if counts:
            keys = list(counts)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([k[0] for k in keys], pa.int32()),
                    pa.array([k[1] for k in keys], pa.int32()),
                    pa.array([counts[k] for k in keys], pa.int64()),
                    pa.array([[str(x) for x in totals[k]] for k in keys], pa.list_(pa.string())),
                ],
                ["position", "entry", "n", "total"],
            )

    return tidy(run)


def updated(members: DataFrame, codebooks: Codebooks) -> Codebooks:
    """Every entry as the floor of the mean of its resident members."""
    widths = [t.shape[1] for t in codebooks.tables]
    sums = members.mapInArrow(
        _resident_sums(widths), "position int, entry int, n long, total array<string>"
    )
    added = [
        F.sum(F.get("total", F.lit(i)).cast("decimal(38,0)")).alias(f"c{i}")
        for i in range(max(widths, default=0))
    ]
    tables = [t.copy() for t in codebooks.tables]
    for row in sums.groupBy("position", "entry").agg(F.sum("n").alias("n"), *added).collect():
        own = [int(row[f"c{i}"]) // row["n"] for i in range(widths[row["position"]])]
        tables[row["position"]][row["entry"]] = own
    return Codebooks(tuple(tables))


def first_codebooks(vectors: DataFrame, unique: str, parts: int, entries: int) -> Codebooks | None:
    """The parts of the vectors of smallest ids; None if there are none."""
    first = vectors.orderBy(F.asc_nulls_last(unique), "vector").limit(1).first()
    if first is None:
        return None
    length = len(first["vector"])
    same = vectors.where(F.size("vector") == length)
    rows = same.orderBy(F.asc_nulls_last(unique), "vector").limit(entries).select("vector").collect()
    table = np.array([r["vector"] for r in rows], dtype=np.int64).reshape(len(rows), length)
    cuts = [i * length // parts for i in range(parts + 1)]
    return Codebooks(tuple(table[:, a:b].copy() for a, b in zip(cuts, cuts[1:], strict=False)))


def fit(vectors: DataFrame, codebooks: Codebooks, rounds: int = ROUNDS) -> Codebooks:
    """``rounds`` of Lloyd over all of ``vectors`` (whole numbers), from given codebooks.

    Each round reads the members where they lie, writes them once, those that stay and those that move
    apart, and shuffles the latter. Tables of earlier rounds are deleted as soon as they are replaced. A
    round in which nothing moves ends the work: later ones would change nothing.
    """
    spark = vectors.sparkSession
    owner = ["position", "entry", "salt"]
    with scratch(spark):
        dealt = vectors.select("vector").mapInArrow(_dealt_members(codebooks), _MEMBER)
        members, path = _written(dealt.repartition(*owner))
        paths = [path]
        for done in range(rounds):
            if done:
                held = members.mapInArrow(_held_against(codebooks), f"{_MEMBER}, moved boolean")
                table, table_path = _written(held, "moved")
                moving = table.where("moved").drop("moved")
                arrived, arrived_path = _written(moving.repartition(*owner))
                for old in paths:
                    delete(spark, old)
                paths = [table_path, arrived_path]
                if arrived.isEmpty():
                    break
                members = table.where("NOT moved").drop("moved").unionByName(arrived)
            codebooks = updated(members, codebooks)
    return codebooks


def _written(table: DataFrame, *by: str) -> tuple[DataFrame, str]:
    """``table`` written to the shared folder, split into folders by some columns, and its path."""
    path = scratch_path(table.sparkSession, "members")
    table.write.partitionBy(*by).parquet(path)
    return table.sparkSession.read.schema(table.schema).parquet(path), path


def encode(vectors: DataFrame, codebooks: Codebooks) -> DataFrame:
    """``vectors`` with ``code`` (two hex digits a part) and ``error`` in place of ``vector``."""
    rest = [f for f in vectors.schema.fields if f.name != "vector"]
    schema = T.StructType(
        [*rest, T.StructField("code", T.StringType()), T.StructField("error", T.LongType())]
    )
    digits = [f"{i:02x}" for i in range(ENTRIES)]

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            codes, error = [""] * n, np.zeros(n, dtype=object)
            for position, table in enumerate(codebooks.tables):
                start, width = codebooks.bounds[position], table.shape[1]
                parts = _block(batch.column("vector"), np.arange(n), start, width)
                entry, distance = nearest_entries(parts, table)
                codes = [c + digits[e] for c, e in zip(codes, entry.tolist(), strict=True)]
                error = error + distance.astype(object)
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(f.name) for f in rest],
                    pa.array(codes, pa.string()),
                    pa.array([min(int(e), _LARGEST) for e in error], pa.int64()),
                ],
                [*[f.name for f in rest], "code", "error"],
            )

    usable = vectors.where(F.size("vector") == codebooks.bounds[-1])
    return usable.mapInArrow(tidy(run), schema)


def compress(
    rows: DataFrame,
    unique: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
) -> DataFrame:
    """``(vec_id, code, error, label_error, codebooks_sha256)`` of every vector that takes part.

    ``label_error`` is the error summed over rows of equal label, null labels together.
    """
    if not 1 <= entries <= ENTRIES:
        raise ValueError(f"an entry has two hex digits: 1 to {ENTRIES} entries")
    narrow = rows.select(
        F.col(f"`{unique}`").alias("vec_id"),
        F.col(f"`{label}`").alias("label"),
        F.col(f"`{vector}`").alias("vector"),
    )
    vectors = materialise(whole_vectors(narrow))
    first = first_codebooks(vectors, "vec_id", parts, entries)
    if first is None:
        nothing = vectors.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
        return nothing.withColumns(
            {"label_error": F.lit(0).cast("long"), "codebooks_sha256": F.lit("")}
        ).where("false")
    alike = vectors.where(F.size("vector") == first.bounds[-1])
    codebooks = fit(alike, first, rounds)
    coded = materialise(encode(alike, codebooks))
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(_LARGEST).cast("decimal(38,0)"))
    errors = coded.groupBy("label").agg(total.cast("long").alias("label_error"))
    joined = lookup_join(coded, errors, ["label"], unique="vec_id")
    return joined.select(
        "vec_id", "code", "error", "label_error", F.lit(codebooks.digest()).alias("codebooks_sha256")
    )
