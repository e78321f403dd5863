"""Repair of conversations at least cost, by bidirectional Dijkstra over the edit lattice.

A node of the lattice is ``(rows used, grammar state)``. The repaired roles must read ``(s?(ua)+)?`` by
their initials, which four states tell apart. Edges are the edits: keep a row (0), give it another role
(3), delete it (4; the only way for blank and duplicate rows), insert an empty user or assistant
turn (3). A truncated row that stays adds 3. Two heaps grow from the start and from the accepting ends
until their next keys add up to more than the best path, so that every crossing of equal cost is
found; of all paths through crossings the one with the least audit (the edits' initials) is taken.

In a given state only one role may come next, so an audit leads to one node, and no audit between
two nodes at equal cost begins with another one. Long conversations are therefore cut into runs of
``RUN_TURNS`` rows: each run is searched from every state it may be entered in to every state it may be left in,
and the runs are put together from the back by cost and by the order of their audits, which gives the
path over the whole. A task holds one run's rows as one byte each; texts stream through in order.

Defined cases. A null role or text counts as one space. Rows of one conversation go by turn, nulls first, and
rows of equal turn by a digest of role and text. A role without a legal initial (an empty one too)
can only be replaced or deleted. Null conversation ids are one conversation. Further columns are ignored.
An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from transferwatch.llm.arrays import tidy
from transferwatch.llm.tables import narrow, ranked
from transferwatch.operators.skew import join_same
from transferwatch.session import materialise

# Rows of a conversation that are searched at once.
RUN_TURNS = 1024

# Fixed values.
RELABEL, DELETE, INSERT, TRUNCATION = 3, 4, 3, 3
INITIALS = "sua"
ROLES = {"u": "user", "a": "assistant"}
# Grammar states: nothing yet, after the system turn, after a user turn, after an assistant turn.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ACCEPTING = (0, 3)
LEGAL_PAIRS = ("su", "ua", "au")
NO_FAULT, BLANK, DUPLICATE, TRUNCATED = range(4)
SPACE = " \t\n\x0b\x0c\r"

# A row's code: place of its initial in INITIALS (3: another one) plus 4 times its fault.
_COUNTS = ("blank", "duplicate", "truncated", "illegal", "cost")


def code_of(initial: str, fault: int) -> int:
    return (INITIALS.find(initial) if initial else -1) % 4 + 4 * fault


def _edits(code: int, state: int) -> list[tuple[int, str, int]]:
    """Edits of a row in a grammar state, as ``(cost, initial, next state)``."""
    initial, fault = INITIALS[code % 4 : code % 4 + 1], code // 4
    edits = [(DELETE, "D", state)]
    if fault in (BLANK, DUPLICATE):
        return edits
    extra = TRUNCATION if fault == TRUNCATED else 0
    for role, after in NEXT[state].items():
        if role == initial:
            edits.append((extra, "K", after))
        elif role in ROLES:
            edits.append((RELABEL + extra, "R", after))
    return edits


def _insertions(state: int) -> list[tuple[int, str, int]]:
    return [(INSERT, "I", after) for role, after in NEXT[state].items() if role in ROLES]


class Lattice:
    """Edges of the edit lattice of some rows; inserting after the last row is allowed or not."""

    def __init__(self, codes: bytes, trailing: bool):
        self.codes, self.trailing = codes, trailing

    def after(self, node: tuple[int, int]) -> list[tuple[int, str, tuple[int, int]]]:
        row, state = node
        edges = []
        if row < len(self.codes):
            edges = [(c, x, (row + 1, s)) for c, x, s in _edits(self.codes[row], state)]
        if row < len(self.codes) or self.trailing:
            edges += [(c, x, (row, s)) for c, x, s in _insertions(state)]
        return edges

    def before(self, node: tuple[int, int]) -> list[tuple[int, str, tuple[int, int]]]:
        row, state = node
        sources = [(row, s) for s in range(4)] + ([(row - 1, s) for s in range(4)] if row else [])
        return [(c, x, source) for source in sources for c, x, n in self.after(source) if n == node]


class _Side:
    """One of the two searches: distances, a heap, and the nodes that are final."""

    def __init__(self, edges, starts):
        self.edges = edges
        self.distance = dict.fromkeys(starts, 0)
        self.heap = [(0, node) for node in starts]
        heapq.heapify(self.heap)
        self.final: dict[tuple[int, int], int] = {}

    def next_key(self) -> float:
        while self.heap and self.heap[0][1] in self.final:
            heapq.heappop(self.heap)
        return self.heap[0][0] if self.heap else float("inf")

    def settle(self) -> tuple[int, tuple[int, int]]:
        key, node = heapq.heappop(self.heap)
        self.final[node] = key
        for cost, _, other in self.edges(node):
            if key + cost < self.distance.get(other, float("inf")):
                self.distance[other] = key + cost
                heapq.heappush(self.heap, (key + cost, other))
        return key, node


@lru_cache(maxsize=4096)
def cheapest(codes: bytes, entry: int, exits: tuple[int, ...], trailing: bool) -> tuple[int, str] | None:
    """Cost and least audit from state ``entry`` before the rows to one of ``exits`` after them."""
    lattice = Lattice(codes, trailing)
    source = (0, entry)
    forward = _Side(lattice.after, [source])
    reverse = _Side(lattice.before, [(len(codes), q) for q in exits])
    best = float("inf")
    while forward.next_key() + reverse.next_key() <= best:
        side, other = (forward, reverse) if forward.next_key() <= reverse.next_key() else (reverse, forward)
        if side.next_key() == float("inf"):
            break
        key, node = side.settle()
        best = min(best, key + other.distance.get(node, float("inf")))
    if best == float("inf"):
        return None
    for side in (forward, reverse):  # nodes as far as the last final one are final too
        reach = max(side.final.values(), default=0)
        while side.next_key() <= reach:
            side.settle()

    # Crossings: an edge from a node the forward search knows to one the reverse search knows.
    crossing: dict[tuple[int, int], list[tuple[str, tuple[int, int]]]] = {}
    for node, gone in forward.final.items():
        for cost, label, other in lattice.after(node):
            left = reverse.final.get(other)
            if left is not None and gone + cost + left == best:
                crossing.setdefault(node, []).append((label, other))
    # Forward nodes from which a crossing is reached by cheapest edges.
    useful, ahead = set(crossing), list(crossing)
    while ahead:
        node = ahead.pop()
        for cost, _, earlier in lattice.before(node):
            known = forward.final.get(earlier)
            if known is not None and known + cost == forward.final[node] and earlier not in useful:
                useful.add(earlier)
                ahead.append(earlier)

    audit, node = [], source
    ends = {(len(codes), q) for q in exits}
    spent = 0
    while not (node in ends and spent == best):
        options = list(crossing.get(node, ()))
        for cost, label, other in lattice.after(node):
            here, there = forward.final.get(node), forward.final.get(other)
            if other in useful and here is not None and there == here + cost:
                options.append((label, other))
            here, there = reverse.final.get(node), reverse.final.get(other)
            if here is not None and there is not None and here == cost + there and here == best - spent:
                options.append((label, other))
        label, other = min(options)
        spent += next(c for c, x, n in lattice.after(node) if (x, n) == (label, other))
        audit.append(label)
        node = other
    return int(best), "".join(audit)


def damage(rows: DataFrame) -> DataFrame:
    """The conversations with faults put in by ``crc32(conv_id:turn) % 20``, a null being one space.

    0 drops a row, 1 empties its text, 2 takes out ``.!?``, 3 gives it twice, 4 makes it a user's.
    """
    def said(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn"))) % 20
    marked = rows.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"),
                         kind.alias("_kind"))
    text = (
        F.when(F.col("_kind") == 1, "")
        .when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", ""))
        .otherwise(F.col("text"))
    )
    copies = F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return (
        marked.where("_kind != 0")
        .withColumn("_copy", F.explode(copies))
        .select(
            "conv_id",
            "turn",
            F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")).alias("role"),
            text.alias("text"),
        )
    )


def in_order(rows: DataFrame) -> DataFrame:
    """The rows with their place in the conversation, written once."""
    whole = narrow(rows, "conv_id", "turn", "role", "text").withColumns(
        {c: F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text")}
    )
    said = F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    digested = whole.withColumn("digest", F.sha2(said, 256))
    return materialise(ranked(digested, ["turn", "digest"], within="conv_id", rank="place"))


def with_codes(ordered: DataFrame) -> DataFrame:
    """``(conv_id, place, code)``: each row's initial and first fault."""
    trimmed = F.rtrim(F.col("text"), F.lit(SPACE))
    seen = ordered.select(
        "conv_id",
        "place",
        "digest",
        F.substring("role", 1, 1).alias("initial"),
        F.substring(trimmed, -1, 1).alias("last"),
    )
    first = seen.groupBy("conv_id", "digest").agg(F.min("place").alias("place"))
    first = first.select("conv_id", "place", F.lit(True).alias("first"))
    faulty = join_same(seen, first, ["conv_id", "place"])  # a place is one row: no key is hot
    fault = (
        F.when(F.col("last") == "", BLANK)
        .when(F.col("first").isNull(), DUPLICATE)
        .when(~F.col("last").isin(".", "!", "?"), TRUNCATED)
        .otherwise(NO_FAULT)
    )
    initial = F.when(F.col("initial") == "s", 0).when(F.col("initial") == "u", 1)
    initial = initial.when(F.col("initial") == "a", 2).otherwise(3)
    return faulty.select("conv_id", "place", (initial + 4 * fault).alias("code"))


def runs_of(codes: DataFrame, run_turns: int) -> DataFrame:
    """``(conv_id, run, codes, before, last)``: the rows of each run in order as an array of codes,
    the code of the row before the run (null at the start), and whether the conversation ends here."""
    at = F.col("place") % run_turns
    run = F.floor(F.col("place") / run_turns)

    def part(number: Column, kind: str) -> Column:
        return F.struct(number.alias("run"), F.lit(kind).alias("kind"))

    # The first row of a later run also tells the run before it that it is not the last one.
    parts = F.array_compact(
        F.array(
            part(run, "own"),
            F.when(at == run_turns - 1, part(run + 1, "before")),
            F.when((at == 0) & (run > 0), part(run - 1, "after")),
        )
    )
    spread = codes.withColumn("part", F.explode(parts)).select("conv_id", "place", "code", "part.*")
    kind = F.col("kind")
    own = F.when(kind == "own", F.struct("place", "code"))
    runs = spread.groupBy("conv_id", "run").agg(
        F.sort_array(F.collect_list(own)).getField("code").alias("codes"),
        F.max(F.when(kind == "before", F.col("code"))).alias("before"),
        (F.count_if(kind == "after") == 0).alias("last"),
    )
    return runs.where(F.size("codes") > 0)


def _searched(batches):
    """For each run its counts, and the cheapest way from every entry to every exit."""
    for batch in batches:
        out = []
        for conv, run, codes, before, last in zip(
            *[batch.column(c).to_pylist() for c in ("conv_id", "run", "codes", "before", "last")], strict=True
        ):
            own = bytes(codes)
            faults = [c // 4 for c in own]
            near = ([] if before is None else [before % 4]) + [c % 4 for c in own]
            pairs = [INITIALS[a : a + 1] + INITIALS[b : b + 1] for a, b in zip(near, near[1:], strict=False)]
            ways = []
            for entry in range(4) if run else (0,):
                for exits in (ACCEPTING,) if last else ((0,), (1,), (2,), (3,)):
                    found = cheapest(own, entry, exits, last)
                    if found:
                        ways.append({"entry": entry, "exit": exits[0], "cost": found[0], "audit": found[1]})
            out.append(
                {
                    "conv_id": conv,
                    "run": run,
                    "last": last,
                    "blank": faults.count(BLANK),
                    "duplicate": faults.count(DUPLICATE),
                    "truncated": faults.count(TRUNCATED),
                    "illegal": sum(p not in LEGAL_PAIRS for p in pairs),
                    "ways": ways,
                }
            )
        yield out


def _way(batches_of, schema: T.StructType):
    """``mapInArrow`` function from one of lists of dicts."""
    arrow = to_arrow_schema(schema)

    def run(batches):
        for rows in batches_of(batches):
            yield pa.RecordBatch.from_pylist(rows, arrow)

    return tidy(run)


def stitch(runs: list[dict]) -> list[tuple[int, int, int]]:
    """``(run, entry, exit)`` of the cheapest path of least audit through the runs of a conversation.

    ``runs`` are in order; their ``ways`` hold entry, exit, cost and the audit's rank among those of
    the same entry.
    """
    left = {0: 0}  # cost from a state after the last run; its ways all end in one pseudo state
    steps: list[dict[int, int]] = []
    for run in reversed(runs):
        best: dict[int, tuple[int, int, int]] = {}
        for way in run["ways"]:
            if way["exit"] in left:
                offer = (way["cost"] + left[way["exit"]], way["rank"], way["exit"])
                best[way["entry"]] = min(best.get(way["entry"], offer), offer)
        left = {entry: offer[0] for entry, offer in best.items()}
        steps.append({entry: offer[2] for entry, offer in best.items()})
    path, state = [], 0
    for run, step in zip(runs, reversed(steps), strict=True):
        path.append((run["run"], state, step[state]))
        state = step[state]
    return path


def plan(ordered: DataFrame, run_turns: int = RUN_TURNS) -> DataFrame:
    """``(conv_id, run, entry, audit, cost, blank, duplicate, truncated, illegal)`` of every run."""
    runs = runs_of(with_codes(ordered), run_turns)
    conv = ordered.schema["conv_id"]
    way = T.StructType().add("entry", "integer").add("exit", "integer").add("cost", "long").add("audit", "string")
    schema = T.StructType([conv]).add("run", "long").add("last", "boolean")
    for name in ("blank", "duplicate", "truncated", "illegal"):
        schema = schema.add(name, "long")
    schema = schema.add("ways", T.ArrayType(way))
    searched = materialise(runs.mapInArrow(_way(_searched, schema), schema))
    whole = searched.where("run = 0 AND last").withColumn("way", F.get("ways", F.lit(0)))
    cut = searched.where("NOT (run = 0 AND last)")

    # What stitching needs of a run: costs, and for equal costs the order of the audits.
    def placed(w: Column) -> Column:
        ahead = F.filter("ways", lambda o: (o["entry"] == w["entry"]) & (o["audit"] < w["audit"]))
        return F.struct(w["entry"].alias("entry"), w["exit"].alias("exit"), w["cost"].alias("cost"),
                        F.size(ahead).alias("rank"))

    slim = cut.select("conv_id", "run", F.transform("ways", placed).alias("ways"))
    steps_schema = T.StructType([conv]).add("run", "long").add("entry", "integer").add("exit", "integer")

    def stitched(frame):
        rows = frame.sort_values("run").to_dict("records")
        found = stitch(rows)
        return pd.DataFrame(
            {
                "conv_id": frame["conv_id"].iloc[:1].repeat(len(found)).to_numpy(),
                "run": [f[0] for f in found],
                "entry": [f[1] for f in found],
                "exit": [f[2] for f in found],
            }
        )

    steps = slim.groupBy("conv_id").applyInPandas(stitched, steps_schema)
    taken = join_same(cut, steps, ["conv_id", "run"], "inner").withColumn(
        "way",
        F.get(
            F.filter(
                "ways",
                lambda w: (w["entry"] == F.col("entry")) & (w["exit"] == F.col("exit")),
            ),
            F.lit(0),
        ),
    )
    names = ["conv_id", "run", "blank", "duplicate", "truncated", "illegal"]
    both = whole.select(*names, "way").unionByName(taken.select(*names, "way"))
    return materialise(both.select(*names, "way.entry", "way.audit", "way.cost"))


def repaired(ordered: DataFrame, planned: DataFrame, run_turns: int = RUN_TURNS) -> DataFrame:
    """The repaired turns ``(conv_id, place, role, text, edit)``, each conversation in order in one
    partition. A task holds a batch of rows and one run's audit, however long the conversation is."""
    run = F.floor(F.col("place") / run_turns).alias("run")
    turns = ordered.select("conv_id", run, F.col("place").alias("at"), "role", "text",
                           F.lit(None).cast("int").alias("entry"), F.lit(None).cast("string").alias("audit"))
    heads = planned.select("conv_id", "run", F.lit(-1).cast("long").alias("at"),
                           F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"),
                           "entry", "audit")
    lined_up = (
        turns.unionByName(heads).repartition("conv_id").sortWithinPartitions("conv_id", "run", "at")
    )
    schema = T.StructType([ordered.schema["conv_id"]]).add("place", "long").add("role", "string")
    schema = schema.add("text", "string").add("edit", "string")
    return lined_up.mapInArrow(_way(_applied, schema), schema)


def _applied(batches):
    state, place, edits, conv = 0, 0, iter(""), None

    def turn(role, text, edit):
        nonlocal place, state
        state = NEXT[state][role[0]]
        place += 1
        return {"conv_id": conv, "place": place - 1, "role": role, "text": text, "edit": edit}

    def inserted():
        role = next(r for r in NEXT[state] if r in ROLES)
        return turn(ROLES[role], "", "I")

    for batch in batches:
        out = []
        for own, run, at, role, text, audit in zip(
            *[batch.column(c).to_pylist() for c in ("conv_id", "run", "at", "role", "text", "audit")],
            strict=True,
        ):
            if at < 0:
                out += [inserted() for _ in edits]  # what is left of an audit are turns at the end
                edits, conv = iter(audit), own
                if run == 0:
                    state = place = 0
                continue
            edit = next(edits)
            while edit == "I":
                out.append(inserted())
                edit = next(edits)
            if edit == "K":
                out.append(turn(role, text, edit))
            elif edit == "R":
                role = next(r for r in NEXT[state] if r in ROLES)
                out.append(turn(ROLES[role], text, edit))
        yield out
    yield [inserted() for _ in edits]


def _hashed(batches):
    """SHA-256 of each conversation's turns, which come in order."""
    conv, sha = None, None
    for batch in batches:
        out = []
        for own, place, role, text in zip(
            *[batch.column(c).to_pylist() for c in ("conv_id", "place", "role", "text")], strict=True
        ):
            if place == 0:
                if sha:
                    out.append({"conv_id": conv, "repaired_sha256": sha.hexdigest()})
                conv, sha = own, hashlib.sha256()
            else:
                sha.update(b"\n")
            sha.update(f"{role}:{text}".encode())
        yield out
    if sha:
        yield [{"conv_id": conv, "repaired_sha256": sha.hexdigest()}]


def report(rows: DataFrame, damaged: DataFrame | None = None, run_turns: int = RUN_TURNS) -> DataFrame:
    """One row per ``conv_id`` of ``rows``: faults found in ``damaged`` (``rows`` itself if not given), the
    cost and audit of the repair, and the SHA-256 of the repaired turns, ``role:text`` joined by newlines."""
    ordered = in_order(rows if damaged is None else damaged)
    planned = plan(ordered, run_turns)
    turns = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    runs = F.sort_array(F.collect_list(F.struct("run", "audit"))).getField("audit")
    conv = rows.schema["conv_id"]
    digests = T.StructType([conv]).add("repaired_sha256", "string")
    found = [
        narrow(rows, "conv_id").distinct(),
        ordered.groupBy("conv_id").agg(F.coalesce(turns, F.lit(0)).alias("gaps")),
        planned.groupBy("conv_id").agg(
            *[F.sum(c).alias(c) for c in _COUNTS], F.array_join(runs, "").alias("audit")
        ),
        repaired(ordered, planned, run_turns).mapInArrow(_way(_hashed, digests), digests),
    ]
    table = found[0]
    for part in found[1:]:
        table = table.unionByName(part, allowMissingColumns=True)
    numbers = ("gaps", *_COUNTS)
    return table.groupBy("conv_id").agg(
        *[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in numbers],
        F.coalesce(F.max("audit"), F.lit("")).alias("audit"),
        F.coalesce(F.max("repaired_sha256"), F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )
