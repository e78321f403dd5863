import hashlib
import itertools
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.fixtures import table
from transferwatch.llm import repair
from transferwatch.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
SPACE = " \t\n\x0b\x0c\r"
GRAMMAR = re.compile(r"(s?(ua)+)?")


def damaged(rows):
    out = []
    for r in rows:
        conv, turn = (" " if x is None else x for x in (r["conv_id"], r["turn"]))
        role, text = (" " if r[c] is None else r[c] for c in ("role", "text"))
        kind = zlib.crc32(f"{conv}:{turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        out += [{"conv_id": r["conv_id"], "turn": r["turn"], "role": role, "text": text}] * (1 + (kind == 3))
    return out


def digest(row):
    return hashlib.sha256(f"{len(row['role'])}:{row['role']}{row['text']}".encode()).hexdigest()


def faults_of(rows):
    seen, found = set(), []
    for r in rows:
        text = r["text"].rstrip(SPACE)
        known = (r["role"], r["text"]) in seen
        seen.add((r["role"], r["text"]))
        found.append("blank" if not text else "duplicate" if known else "truncated" if text[-1] not in ".!?" else "")
    return found


def cheapest_by_dp(rows, faults):
    """From the back: the best end from each (row, grammar state), by cost, then audit."""
    steps = [{"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}]
    best = {0: (0, "", ()), 3: (0, "", ())}

    def with_insertions(best):
        for _ in range(3):
            for state in range(4):
                for role, after in steps[state].items():
                    if role in "ua" and after in best:
                        cost, audit, lines = best[after]
                        name = {"u": "user", "a": "assistant"}[role]
                        offer = (cost + 3, "I" + audit, (f"{name}:", *lines))
                        best[state] = min(best.get(state, offer), offer, key=lambda o: o[:2])
        return best

    best = with_insertions(best)
    for r, fault in zip(reversed(rows), reversed(faults), strict=True):
        new = {}
        for state in range(4):
            offers = []
            if state in best:
                cost, audit, lines = best[state]
                offers.append((cost + 4, "D" + audit, lines))
            if fault not in ("blank", "duplicate"):
                extra = 3 * (fault == "truncated")
                for role, after in steps[state].items():
                    if after not in best:
                        continue
                    cost, audit, lines = best[after]
                    if r["role"][:1] == role:
                        offers.append((cost + extra, "K" + audit, (f"{r['role']}:{r['text']}", *lines)))
                    if role in "ua":
                        name = {"u": "user", "a": "assistant"}[role]
                        offers.append((cost + 3 + extra, "R" + audit, (f"{name}:{r['text']}", *lines)))
            if offers:
                new[state] = min(offers, key=lambda o: o[:2])
        best = with_insertions(new)
    return best[0]


def brute(original):
    rows = damaged(original)
    order = {}
    for r in rows:
        order.setdefault(r["conv_id"], []).append(r)
    out = {}
    for conv in {r["conv_id"] for r in original}:
        own = sorted(
            order.get(conv, []), key=lambda r: (r["turn"] is not None, r["turn"] or 0, digest(r))
        )
        faults = faults_of(own)
        turns = [r["turn"] for r in own if r["turn"] is not None]
        pairs = [a["role"][:1] + b["role"][:1] for a, b in itertools.pairwise(own)]
        cost, audit, lines = cheapest_by_dp(own, faults)
        count = Counter(faults)
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            count["blank"], count["duplicate"], count["truncated"],
            sum(p not in ("su", "ua", "au") for p in pairs),
            cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


def found_by(frame):
    return {
        r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256)
        for r in frame.collect()
    }


def test_query_equals_brute_force(spark):
    rows = table("conversations")
    found = found_by(QUERIES["op11_conversation_repair"](spark, SF))
    assert found == brute(rows)
    assert any(f[5] for f in found.values())


def enumerated(codes, entry, exits, trailing, most):
    """All edit sequences up to a cost, one by one."""
    lattice, ends = repair.Lattice(codes, trailing), {(len(codes), q) for q in exits}
    found, ahead = [], [(0, "", (0, entry))]
    while ahead:
        cost, audit, node = ahead.pop()
        if node in ends:
            found.append((cost, audit))
        ahead += [
            (cost + c, audit + x, n) for c, x, n in lattice.after(node) if cost + c <= most
        ]
    return min(found, default=None)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 15), max_size=4), st.integers(0, 3), st.booleans())
def test_cheapest_against_enumeration(codes, entry, trailing):
    for exits in ((0, 3), (0,), (1,), (2,), (3,)):
        found = repair.cheapest(bytes(codes), entry, exits, trailing)
        most = found[0] if found else 12
        assert found == enumerated(bytes(codes), entry, exits, trailing, most)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 15), min_size=1, max_size=40), st.integers(1, 7))
def test_runs_together_are_the_whole(codes, size):
    runs = []
    pieces = [bytes(codes[i : i + size]) for i in range(0, len(codes), size)]
    for k, own in enumerate(pieces):
        last = k == len(pieces) - 1
        ways = []
        for entry in range(4) if k else (0,):
            for exits in ((0, 3),) if last else ((0,), (1,), (2,), (3,)):
                way = repair.cheapest(own, entry, exits, last)
                if way:
                    ways.append({"entry": entry, "exit": exits[0], "cost": way[0], "audit": way[1]})
        for w in ways:
            w["rank"] = sum(o["entry"] == w["entry"] and o["audit"] < w["audit"] for o in ways)
        runs.append({"run": k, "ways": ways})
    taken = [
        next(w for w in run["ways"] if (w["entry"], w["exit"]) == (entry, left))
        for run, (_, entry, left) in zip(runs, repair.stitch(runs), strict=True)
    ]
    whole = repair.cheapest(bytes(codes), 0, (0, 3), True)
    assert (sum(w["cost"] for w in taken), "".join(w["audit"] for w in taken)) == whole


ODD = [
    (1, None, None, None),
    (1, 0, "user", "Hello there."),
    (1, 1, "assistant", "cut off"),
    (1, 1, "assistant", "cut off"),
    (2, 5, "system", "Be kind."),
    (2, 9, "assistant", " \n\t "),
    (3, 0, "tool", "Result."),
    (3, 1, "", "No role."),
    (3, 2, "usher", "Legal by its initial!"),
    (None, 0, "user", "No id."),
    (None, 1, "assistant", "Answer, żółw 你好?"),
    (4, 0, "assistant", "x" * 300_000 + ".\n\n"),
    (5, 0, "user", "a?"),
    (7, None, "user", "one."),
    (7, None, "assistant", "two."),
]


@pytest.mark.parametrize("run_turns", [2, 3, 1024])
def test_odd_cases_and_long_conversations(spark, run_turns):
    rows = [dict(zip(("conv_id", "turn", "role", "text"), r, strict=True)) for r in ODD]
    words = ["Yes.", "no", "", "What? ", "So!", "yes."]
    for i in range(90):
        role = ("user", "assistant", "system", "user")[(i * 7 + i // 5) % 4]
        rows.append({"conv_id": 50, "turn": i + i // 11, "role": role, "text": words[i * i % 6] + str(i // 4) * (i % 3)})
    schema = "conv_id long, turn long, role string, text string, run long, audit string, place long"
    frame = spark.createDataFrame([(*r.values(), 1, "x", 2) for r in rows], schema)
    found = found_by(repair.report(frame, repair.damage(frame), run_turns))
    assert found == brute(rows)
    ordered = repair.in_order(repair.damage(frame))
    fixed = repair.repaired(ordered, repair.plan(ordered, run_turns), run_turns).collect()
    for conv in found:
        own = sorted((r for r in fixed if r.conv_id == conv), key=lambda r: r.place)
        assert [r.place for r in own] == list(range(len(own)))
        assert GRAMMAR.fullmatch("".join(r.role[0] for r in own))


def test_empty_table_and_nothing_left(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert repair.report(spark.createDataFrame([], schema)).count() == 0
    gone = next(t for t in range(1000) if zlib.crc32(f"9:{t}".encode()) % 20 == 0)
    frame = spark.createDataFrame([(9, gone, "user", "Hi.")], schema)
    empty = hashlib.sha256(b"").hexdigest()
    assert found_by(repair.report(frame, repair.damage(frame))) == {9: (0, 0, 0, 0, 0, 0, "", empty)}
