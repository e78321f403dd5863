"""Near-duplicate groups by an exact metric-space join under the Jaccard distance.

A document is the set of its distinct shingles. Two documents link when the Jaccard distance of
their sets is at most ``1 - MIN_PERCENT / 100``; groups are what links connect.

*Cells.* Most sets share nothing, so pivots that tell them apart must be small: every shingle is a
pivot, and they are ordered, rarest first. The cell of a pivot holds the sets whose first shingle it
is. A set that has ``j`` shingles before a pivot is at distance ``j / n`` from the nearest possible
member of its cell (take those ``j`` away), so by the triangle inequality it can only link to
members if ``j / n`` is within the distance asked for: it is replicated to the cells of that window
and to no others. Two linked sets always meet in the cell of the first shingle they share.

*Regions.* Inside the cells that hold different sets, documents are pivots. Each round takes some
sets of every cell as pivots and measures the other members against them: members already connected
to the pivot excepted, and those whose windows share too few cells with the pivot's. With the distances to a cell's first pivot, the triangle inequality rules out
pairs that lie too far apart. A pivot has then met all its cell and leaves it. Cells whose members
have become connected are done; the others go on recursively with more pivots, until none is left.
A group of thousands of near copies thus takes some pivots' distances, not all pairs.

The result is exact: cells and windows lose no pair, and each link is decided by counting common
shingles. Shingles are 64-bit hashes; equal sets are found by two independent 64-bit sums, and if
the first of them is not unique, it is made anew with another seed. The frequencies behind the order
only have to be the same everywhere, so each task reports its most frequent shingles alone.

Defined results: a null or empty text, or one without words, has the empty set, is linked with
nothing and is its own group. Fewer words than a shingle make one shingle. Null ids take part; a
group's id is its smallest id, null only if all are. Repeated rows are copies. Letters A-Z count as
lower case. Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from transferwatch.llm.arrays import Texts, chunks, mix, random_words, signed, tidy, windows
from transferwatch.llm.tables import small, written_and_counted
from transferwatch.session import materialise

SHINGLE_WORDS = 5
MIN_PERCENT = 80
# Shingles a task reports as frequent, and those that are ordered by frequency in the end.
LOCAL_FREQUENT = 20_000
GLOBAL_FREQUENT = 200_000
_COUNTED_AT_ONCE = 1 << 20
# Pivots of a cell in each round; later rounds take the last number.
PIVOTS = (1, 32, 512)


def shingle_sets(texts: Texts, size: int = SHINGLE_WORDS) -> list[np.ndarray]:
    """The sorted distinct shingles of each text."""
    words = texts.words()
    hashes, owner = words.hashes(), words.owner
    values, first = windows(hashes, owner, size)
    starts = np.searchsorted(owner[first], np.arange(len(texts) + 1))
    seeds = random_words(size + 1, 11)
    out = []
    for i, count in enumerate(words.counts.tolist()):
        if count >= size:
            out.append(np.unique(values[starts[i] : starts[i + 1]]))
        elif count:
            own = hashes[words.first[i] : words.first[i + 1]]
            factors = random_words(count, 7) | np.uint64(1)
            total = (own * factors).sum(dtype=np.uint64, keepdims=True)
            out.append(mix(total + seeds[count : count + 1]))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def set_sums(sets: list[np.ndarray], seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers that tell sets apart, whatever the order of their members."""
    a, b = random_words(2, 100 + seed)
    one = [mix(s + a).sum(dtype=np.uint64) for s in sets]
    two = [mix(s ^ b).sum(dtype=np.uint64) for s in sets]
    return np.array(one, dtype=np.uint64), np.array(two, dtype=np.uint64)


def sets_of(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in batches:
        for rows, texts in chunks(batch, "text", lower=True):
            yield batch.slice(rows.start, len(texts)), shingle_sets(texts, size)


def frequent(values: list[np.ndarray], limit: int) -> tuple[np.ndarray, np.ndarray]:
    """The values that occur most often in some sets, and how often."""
    found, counts = np.unique(np.concatenate(values), return_counts=True)
    again = counts > 1
    found, counts = found[again], counts[again]
    if len(found) > limit:
        top = np.argpartition(counts, -limit)[-limit:]
        found, counts = found[top], counts[top]
    return found, counts


def described(docs: DataFrame, size: int, seed: int) -> DataFrame:
    """One row per document, ``(doc_id, id, other, n)``, and rows ``(shingle, seen)``."""

    def run(batches):
        names = ["doc_id", "id", "other", "n", "shingle", "seen"]
        pending: list[np.ndarray] = []
        held = 0
        known: set[int] = set()

        def report():
            found, seen = frequent(pending, LOCAL_FREQUENT)
            none = pa.nulls(len(found), pa.int64())
            return pa.RecordBatch.from_arrays(
                [none, none, none, none, pa.array(signed(found)), pa.array(seen, pa.int64())], names
            )

        for batch, sets in sets_of(batches, size):
            one, two = set_sums(sets, seed)
            n = np.array([len(s) for s in sets])
            empty = n == 0
            none = pa.nulls(len(sets), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()),
                    pa.array(signed(one), mask=empty),
                    pa.array(signed(two), mask=empty),
                    pa.array(n, pa.int64()),
                    none,
                    none,
                ],
                names,
            )
            for key, s in zip(one.tolist(), sets, strict=True):
                if key not in known:
                    known.add(key)
                    pending.append(s)
                    held += len(s)
            if held > _COUNTED_AT_ONCE:
                yield report()
                pending, held = [], 0
        if pending:
            yield report()

    schema = "doc_id long, id long, other long, n long, shingle long, seen long"
    return docs.select("doc_id", "text").mapInArrow(tidy(run), schema)


def frequency_order(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles, sorted by value, and each one's place from rare to frequent."""
    top = (
        rows.where("shingle is not null")
        .groupBy("shingle")
        .agg(F.sum("seen").alias("seen"))
        .orderBy(F.desc("seen"), "shingle")
        .limit(GLOBAL_FREQUENT)
        .toArrow()
    )
    values = top.column("shingle").to_numpy().view(np.uint64)
    place = np.lexsort((values, top.column("seen").to_numpy())).argsort() + 1
    order = np.argsort(values)
    return values[order], place[order].astype(np.int32)


def cell_entries(
    docs: DataFrame, size: int, seed: int, order: tuple[np.ndarray, np.ndarray], percent: int
) -> DataFrame:
    """``(cell, id, place)``: every set with the cells its window reaches, once per task and set.

    ``place`` is how many of the set's shingles come before the cell's.
    """
    sent = docs.sparkSession.sparkContext.broadcast(order)

    def run(batches):
        values, places = sent.value
        known: set[int] = set()
        for _, sets in sets_of(batches, size):
            one, _ = set_sums(sets, seed)
            cells, ids, places_in = [], [], []
            for key, s in zip(one.tolist(), sets, strict=True):
                if not len(s) or key in known:
                    continue
                known.add(key)
                reach = len(s) - -(-percent * len(s) // 100) + 1
                if len(values):
                    at = np.minimum(np.searchsorted(values, s), len(values) - 1)
                    often = values[at] == s
                    rare = s[~often][:reach]
                    if len(rare) < reach:
                        common = s[often][np.argsort(places[at[often]])]
                        rare = np.concatenate([rare, common[: reach - len(rare)]])
                else:
                    rare = s[:reach]
                cells.append(rare)
                ids.append(np.full(len(rare), key, dtype=np.uint64))
                places_in.append(np.arange(len(rare), dtype=np.int32))
            if cells:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(signed(np.concatenate(cells))),
                        pa.array(signed(np.concatenate(ids))),
                        pa.array(np.concatenate(places_in)),
                    ],
                    ["cell", "id", "place"],
                )

    return docs.select("text").mapInArrow(tidy(run), "cell long, id long, place int")


def needed_sets(docs: DataFrame, ids: DataFrame, n_ids: int, size: int, seed: int) -> DataFrame:
    """``(id, n, shingles)`` of the sets in ``ids``, one row each."""

    def run(batches):
        known: set[int] = set()
        for _, sets in sets_of(batches, size):
            one, _ = set_sums(sets, seed)
            pick = [i for i, (k, s) in enumerate(zip(one.tolist(), sets, strict=True)) if len(s) and k not in known]
            chosen, first = [], {}
            for i in pick:
                if first.setdefault(int(one[i]), i) == i:
                    chosen.append(i)
            known.update(first)
            if chosen:
                own = [sets[i] for i in chosen]
                offsets = np.concatenate([[0], np.cumsum([len(s) for s in own])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(
                    pa.array(offsets), pa.array(signed(np.concatenate(own)), pa.int64())
                )
                yield pa.RecordBatch.from_arrays([pa.array(signed(one[chosen])), lists], ["id", "shingles"])

    rows = docs.select("text").mapInArrow(tidy(run), "id long, shingles array<long>")
    found = rows.join(small(ids, n_ids), "id", "left_semi")
    return found.groupBy("id").agg(F.any_value("shingles").alias("shingles"))


def measured(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``(a, b, distance, linked)`` of each pair ``(a, b)``."""
    a = sets.select(F.col("id").alias("a"), F.col("shingles").alias("_sa"))
    b = sets.select(F.col("id").alias("b"), F.col("shingles").alias("_sb"))
    both = F.size(F.array_intersect("_sa", "_sb"))
    either = F.size("_sa") + F.size("_sb") - F.col("_both")
    return (
        pairs.join(a, "a")
        .join(b, "b")
        .select("a", "b", both.alias("_both"), "_sa", "_sb")
        .select(
            "a",
            "b",
            (1 - F.col("_both") / either).alias("distance"),
            (F.col("_both") * 100 >= either * percent).alias("linked"),
        )
    )


def connected(edges: DataFrame) -> DataFrame:
    """``(id, group)``: the smallest id reachable from each end of the edges ``(a, b)``.

    Each round takes the smallest label among neighbours, then the label's own label, so long
    chains halve; every round's labels are written.
    """
    both = materialise(
        edges.select(F.col("a").alias("id"), F.col("b").alias("near"))
        .union(edges.select("b", "a"))
        .distinct()
    )
    labels = materialise(both.groupBy("id").agg(F.least("id", F.min("near")).alias("group")))
    while True:
        near = labels.select(F.col("id").alias("near"), F.col("group").alias("_near"))
        heard = both.join(near, "near").groupBy("id").agg(F.min("_near").alias("_heard"))
        step = labels.join(heard, "id").select(
            "id", F.col("group").alias("_old"), F.least("group", "_heard").alias("group")
        )
        up = labels.select(F.col("id").alias("group"), F.col("group").alias("_up"))
        step = materialise(
            step.join(up, "group").select("id", "_old", F.least("group", "_up").alias("group"))
        )
        changed = step.where("_old <> group").limit(1).count()
        labels = step.select("id", "group")
        if not changed:
            return labels


def shared_cells(entries: DataFrame) -> DataFrame:
    """The entries, once each, of the cells that hold different sets."""
    shared = entries.groupBy("cell").agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
    shared, n = written_and_counted(shared.where("lo <> hi").select("cell"))
    return entries.join(small(shared, n), "cell", "left_semi").distinct()


class Sets:
    """The sets that pairs ask for, read from the texts when they are first needed."""

    def __init__(self, docs: DataFrame, size: int, seed: int):
        self.docs, self.size, self.seed = docs, size, seed
        self.table: DataFrame | None = None

    def holding(self, pairs: DataFrame) -> DataFrame:
        """A table with the sets of all ``pairs (a, b)``."""
        ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
        if self.table is not None:
            ids = ids.join(self.table.select("id"), "id", "left_anti")
        ids, count = written_and_counted(ids)
        if count:
            more = materialise(needed_sets(self.docs, ids, count, self.size, self.seed))
            self.table = more if self.table is None else self.table.union(more)
        return self.table


def may_link(pairs: DataFrame, fronts: DataFrame, percent: int) -> DataFrame:
    """The pairs whose windows have as many cells in common as linked sets must have.

    Sets of ``n`` and ``m`` shingles that link share at least ``o = ceil(p (n + m) / (100 + p))``.
    Of those the first ``l`` lie among the first ``n - o + l`` of the one and ``m - o + l`` of the
    other, so windows of ``w`` and ``v`` share ``min(w - n + o, v - m + o)`` cells.
    """
    left = fronts.toDF("a", "_na", "_fa")
    right = fronts.toDF("b", "_nb", "_fb")
    common = F.expr(f"(({percent} * (_na + _nb) + {99 + percent}) div {100 + percent})")
    spare = [common - F.expr(f"(({percent} * {n} + 99) div 100)") + 1 for n in ("_na", "_nb")]
    enough = F.size(F.array_intersect("_fa", "_fb")) >= F.least(*spare)
    return pairs.join(left, "a").join(right, "b").where(enough).select("a", "b")


def linked_groups(members: DataFrame, sizes: DataFrame, sets: Sets, percent: int) -> DataFrame:
    """``(id, group)`` of all sets in ``members (cell, id, place)``, by rounds of pivots.

    Pivots are taken first among the sets whose windows hold the fewest cells of their own: in a
    group of copies these lie in its middle, so most members link to them at once.
    """
    fronts = members.groupBy("id").agg(F.collect_set("cell").alias("front"))
    fronts = materialise(sizes.join(fronts, "id").select("id", "n", "front"))
    own = F.expr(f"n - (({percent} * n + 99) div 100) + 1") - F.size("front")
    sized = members.join(fronts.select("id", "n", own.alias("own")), "id")
    open_ = materialise(sized.withColumn("near", F.lit(None).cast("double")))
    groups = fronts.select("id", F.col("id").alias("group"))
    tested = None
    step = 0
    common = F.expr(f"(({percent} * (n + pivot_n) + {99 + percent}) div {100 + percent})")
    reach = 1 - percent / 100
    while True:
        labelled = open_.join(groups, "id")
        mixed = labelled.groupBy("cell").agg(F.min("group").alias("lo"), F.max("group").alias("hi"))
        mixed = mixed.where("lo <> hi").select("cell")
        open_, left = written_and_counted(labelled.join(mixed, "cell", "left_semi"))
        if not left:
            return groups
        first = W.partitionBy("cell").orderBy("own", F.xxhash64("id"), "id")
        count = PIVOTS[min(step, len(PIVOTS) - 1)]
        chosen = open_.withColumn("_place", F.row_number().over(first)).where(F.col("_place") <= count)
        pivots = materialise(
            chosen.select(
                "cell",
                F.col("id").alias("pivot"),
                F.col("n").alias("pivot_n"),
                F.col("place").alias("pivot_place"),
                F.col("group").alias("pivot_group"),
                F.col("near").alias("pivot_near"),
            )
        )
        met = open_.join(pivots, "cell").where(
            (F.col("group") != F.col("pivot_group"))
            & (F.least("n", "pivot_n") * 100 >= F.greatest("n", "pivot_n") * percent)
            # The first common cell of sets that link leaves room for all they must share.
            & (F.col("place") <= F.col("n") - common)
            & (F.col("pivot_place") <= F.col("pivot_n") - common)
            # Distances to the cell's first pivot, where both are known, bound the distance.
            & F.coalesce(F.abs(F.col("near") - F.col("pivot_near")) <= reach + 1e-9, F.lit(True))
        )
        pairs = met.select(
            F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")
        ).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs, n_pairs = written_and_counted(pairs)
        close, n_close = written_and_counted(may_link(pairs, fronts, percent)) if n_pairs else (None, 0)
        found = None
        if n_close:
            found = materialise(measured(close, sets.holding(close), percent))
            edges = found.where("linked").select("a", "b")
            if edges.limit(1).count():
                groups = materialise(merged(groups, edges))
        gone = pivots.select("cell", F.col("pivot").alias("id"))
        open_ = open_.drop("group").join(gone, ["cell", "id"], "left_anti")
        if step == 0 and found is not None:
            pivot = pivots.select("cell", "pivot")
            pair = [F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")]
            open_ = (
                open_.drop("near")
                .join(pivot, "cell")
                .select("cell", "id", "place", "n", "own", *pair)
                .join(found.select("a", "b", F.col("distance").alias("near")), ["a", "b"], "left")
                .select("cell", "id", "place", "n", "own", "near")
            )
        if n_pairs:
            tested = pairs if tested is None else tested.union(pairs)
        step += 1


def merged(groups: DataFrame, edges: DataFrame) -> DataFrame:
    """``groups`` after joining those that the edges ``(a, b)`` between ids connect."""
    a = groups.select(F.col("id").alias("a"), F.col("group").alias("_a"))
    b = groups.select(F.col("id").alias("b"), F.col("group").alias("_b"))
    between = edges.join(a, "a").join(b, "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
    new = connected(between).select(F.col("id").alias("group"), F.col("group").alias("_new"))
    return groups.join(new, "group", "left").select("id", F.coalesce("_new", "group").alias("group"))


def near_duplicates(
    docs: DataFrame, size: int = SHINGLE_WORDS, percent: int = MIN_PERCENT
) -> tuple[DataFrame, int]:
    """``(doc_id, id, n, group, class_doc, group_doc)`` of every row, and the seed of the ids.

    ``id`` stands for the set (null if empty), ``group`` for what links connect, and ``class_doc``
    and ``group_doc`` are the smallest documents with the set and in the group.
    """
    seed = 0
    while True:
        rows = materialise(described(docs, size, seed))
        found = rows.where("n is not null").select("doc_id", "id", "other", "n")
        classes = found.where("id is not null").groupBy("id").agg(
            F.min("doc_id").alias("class_doc"),
            F.min(F.struct("other", "n")).alias("lo"),
            F.max(F.struct("other", "n")).alias("hi"),
        )
        classes = materialise(classes)
        if not classes.where("lo <> hi").limit(1).count():
            break
        seed += 1  # two different sets had the same number
    entries = materialise(cell_entries(docs, size, seed, frequency_order(rows), percent))
    members = materialise(shared_cells(entries))
    sizes = classes.select("id", F.col("lo.n").alias("n"))
    groups = linked_groups(members, sizes, Sets(docs, size, seed), percent)
    classes = classes.join(groups, "id", "left").withColumn("group", F.coalesce("group", "id"))
    classes = materialise(classes.select("id", "class_doc", "group"))
    heads = classes.groupBy("group").agg(F.min("class_doc").alias("group_doc"))
    named = materialise(classes.join(heads, "group").select("id", "group", "class_doc", "group_doc"))
    rows = found.join(named, "id", "left")
    return rows.select("doc_id", "id", "n", "group", "class_doc", "group_doc"), seed


def components(docs: DataFrame, size: int = SHINGLE_WORDS, percent: int = MIN_PERCENT) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` of every row."""
    found, _ = near_duplicates(docs, size, percent)
    own = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("group_doc"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def one_of_each(docs: DataFrame, size: int = SHINGLE_WORDS, percent: int = MIN_PERCENT) -> DataFrame:
    """``docs`` with one row of each group: that of the smallest id, with all its columns.

    Rows with the empty set all stay. Of rows with the same id and the same set, one stays.
    """
    found, seed = near_duplicates(docs, size, percent)
    found = materialise(found)
    heads = (
        found.where("id is not null")
        .groupBy("group")
        .agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "id")).alias("head"))
    )
    copies = found.groupBy("doc_id", "id").agg(F.count("*").alias("_copies"))
    kept, n = written_and_counted(
        copies.join(
            heads.select(F.col("head.doc_id").alias("_doc"), F.col("head.id").alias("_id")),
            F.col("id").eqNullSafe(F.col("_id")) & F.col("doc_id").eqNullSafe(F.col("_doc")),
        ).select("_doc", "_id", "_copies")
    )
    repeated = bool(kept.where("_copies > 1").limit(1).count())
    plain = docs.toDF(*[f"_c{i}" for i in range(len(docs.columns))])
    names = dict(zip(docs.columns, plain.columns, strict=True))
    keyed = with_set_id(plain, names["text"], size, seed)
    match = F.col("_set").eqNullSafe(F.col("_id")) & F.col(names["doc_id"]).eqNullSafe(F.col("_doc"))
    joined = keyed.join(small(kept, n), match, "left")
    out = joined.where("_set is null or _copies = 1").select(*plain.columns)
    if repeated:
        again = joined.where("_copies > 1").dropDuplicates([names["doc_id"], "_set"])
        out = out.union(again.select(*plain.columns))
    return out.toDF(*docs.columns)


def with_set_id(docs: DataFrame, text: str, size: int, seed: int) -> DataFrame:
    """``docs`` with the number of each row's set as ``_set``, null for the empty set."""
    schema = T.StructType([*docs.schema.fields, T.StructField("_set", T.LongType())])

    def run(batches):
        for batch in batches:
            column = pa.RecordBatch.from_arrays([batch.column(text)], ["text"])
            ids, empty = [], []
            for _, sets in sets_of([column], size):
                ids.append(set_sums(sets, seed)[0])
                empty.extend(len(s) == 0 for s in sets)
            if ids:
                own = pa.array(signed(np.concatenate(ids)), mask=np.array(empty))
                yield pa.RecordBatch.from_arrays([*batch.columns, own], [*batch.schema.names, "_set"])

    return docs.mapInArrow(tidy(run), schema)
