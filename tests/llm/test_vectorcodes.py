import hashlib
import math

import numpy as np
import pytest

from tests.llm.fixtures import table
from transferwatch.llm import vectorcodes
from transferwatch.llm.queries import QUERIES


def brute(rows, parts=4, entries=256, rounds=4):
    """Plain Lloyd over ``(vec_id, vector, label)`` in Python's whole numbers."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, list(r[1])))
    kept = [(i, [math.floor(1024 * x) for x in v], lab) for i, v, lab in kept if len(v) == len(kept[0][1])]
    length = len(kept[0][1])
    cuts = [i * length // parts for i in range(parts + 1)]
    books = [[v[a:b] for _, v, _ in kept[:entries]] for a, b in zip(cuts, cuts[1:])]

    def nearest(part, book):
        gaps = [sum((x - c) ** 2 for x, c in zip(part, entry)) for entry in book]
        return gaps.index(min(gaps)), min(gaps)

    for _ in range(rounds):
        for p, (a, b) in enumerate(zip(cuts, cuts[1:])):
            members = {}
            for _, v, _ in kept:
                members.setdefault(nearest(v[a:b], books[p])[0], []).append(v[a:b])
            books[p] = [
                [sum(c) // len(members[e]) for c in zip(*members[e])] if e in members else book
                for e, book in enumerate(books[p])
            ]
    numbers = ",".join(str(x) for book in books for entry in book for x in entry)
    found, by_label = [], {}
    for i, v, lab in kept:
        own = [nearest(v[a:b], books[p]) for p, (a, b) in enumerate(zip(cuts, cuts[1:]))]
        error = sum(d for _, d in own)
        by_label[lab] = by_label.get(lab, 0) + error
        found.append((i, "".join(f"{e:02x}" for e, _ in own), error, lab))
    digest = hashlib.sha256(numbers.encode()).hexdigest()
    return sorted((str(i), c, e, by_label[lab], digest) for i, c, e, lab in found)


def shown(frame):
    return sorted(
        (str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in frame.collect()
    )


def test_query_equals_plain_lloyd(spark):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in table("embeddings")]
    found = shown(QUERIES["op12_vector_codes"](spark, "/root/testdata/sf0.001"))
    assert found == brute(rows)


SCHEMA = "vec_id long, embedding array<float>, label int, entry long, salt long, code string"


def frame_of(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA)


def odd_rows():
    made = np.random.default_rng(3).normal(size=(40, 7)).round(2)
    rows = [(i, v.tolist(), i % 3 or None) for i, v in enumerate(made)]
    rows += [(100 + i, [0.5, -0.25, 1.0, 2.0, -3.0, 0.0, 0.125], 1) for i in range(60)]  # copies
    rows += [(100, [0.5] * 7, 1), (None, [0.25] * 7, None)]  # a repeated and a missing id
    rows += [(201, None, 1), (202, [1.0, None] + [0.0] * 5, 1), (203, [float("nan")] * 7, 1)]
    rows += [(204, [float("inf")] + [0.0] * 6, 1), (205, [], 1), (206, [1.0], 1)]
    return rows


@pytest.mark.parametrize("entries", [1, 5, 256])
def test_odd_cases(spark, entries):
    rows = odd_rows()
    found = shown(vectorcodes.compress(frame_of(spark, rows), entries=entries))
    assert found == brute(rows, entries=entries)


def test_only_what_changes_moves(spark, monkeypatch):
    """Each later round shuffles the parts whose entry is new, and no others."""
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in table("embeddings")]
    frame = spark.createDataFrame(rows, "vec_id long, vector array<float>, label int")
    vectors = vectorcodes.whole_vectors(frame)
    books = vectorcodes.first_codebooks(vectors, "vec_id", 4, 16)
    sizes, written = [], vectorcodes._written

    def counted(table, *by):
        out = written(table, *by)
        sizes.append((by, out[0].count()))
        return out

    monkeypatch.setattr(vectorcodes, "_written", counted)
    final = vectorcodes.fit(vectors, books)
    whole = np.array([[math.floor(1024 * x) for x in v] for _, v, _ in rows])

    def assigned(tables):
        cuts = np.cumsum([0] + [t.shape[1] for t in tables])
        return np.stack([vectorcodes.nearest_entries(whole[:, a:b], t)[0]
                         for t, a, b in zip(tables, cuts, cuts[1:])])

    state, before, moved = books, assigned(books.tables), []
    for r in range(4):
        tables = []
        for p, t in enumerate(state.tables):
            own = whole[:, p * 16 : p * 16 + 16]
            new = t.copy()
            for e in np.unique(before[p]):
                new[e] = own[before[p] == e].sum(0) // (before[p] == e).sum()
            tables.append(new)
        state = vectorcodes.Codebooks(tuple(tables))
        after = assigned(state.tables)
        moved.append(int((after != before).sum()))
        before = after
    assert all((a == b).all() for a, b in zip(final.tables, state.tables))
    assert sizes[0][1] == 4 * len(rows)
    assert [n for by, n in sizes[1:] if not by] == moved[:3]
    assert 0 < moved[1] < 2 * len(rows)


def test_exact_beyond_doubles():
    parts = np.array([[2**40, 1], [2**40 + 1, 0]])
    book = np.array([[2**40 + 1, 1], [2**40, 1], [2**40, 1]])
    entry, gap = vectorcodes.nearest_entries(parts, book)
    assert entry.tolist() == [1, 0] and list(gap) == [0, 1]


def test_wide_values(spark):
    rows = [(i, [x, 1.0, 2.0, 3.0], None) for i, x in enumerate([3e9, 3.5e9, -2.816e9, 1.0, 3e9])]
    found = shown(vectorcodes.compress(frame_of(spark, rows), entries=2))
    largest = 2**63 - 1
    assert found == [
        (i, code, min(error, largest), min(label_error, largest), digest)
        for i, code, error, label_error, digest in brute(rows, entries=2)
    ]


def test_empty_tables(spark):
    for rows in ([], [(1, None, 1)]):
        assert vectorcodes.compress(frame_of(spark, rows)).count() == 0
