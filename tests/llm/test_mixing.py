import random

import pytest
from hypothesis import given
from hypothesis import strategies as st

from tests.llm.fixtures import empty_documents, odd_documents
from transferwatch.llm import mixing
from transferwatch.llm.queries import QUERIES


@given(st.lists(st.integers(1, 40), min_size=1, max_size=12))
def test_every_block_lies_in_its_window(weights):
    named = {f"s{i}": w for i, w in enumerate(weights)}
    places = mixing.one_period(named)
    period = sum(weights)
    assert sorted(p for own in places.values() for p in own) == list(range(period))
    for s, own in places.items():
        for block, slot in enumerate(own):
            release, due = mixing.window(block, named[s], period)
            assert release <= slot < due


@given(st.dictionaries(st.text("abc", min_size=1, max_size=3), st.floats(0.001, 1000), min_size=1, max_size=30))
def test_whole_weights(targets):
    out = mixing.whole_weights(targets, 1000)
    assert sum(out.values()) == 1000 and min(out.values()) >= 1
    if min(targets.values()) > sum(targets.values()) / 100:
        assert all(abs(out[s] - 1000 * w / sum(targets.values())) <= 1 + 1e-6 for s, w in targets.items())


def check_mixture(rows, block_rows):
    assert sorted(r.position for r in rows) == list(range(len(rows)))
    assert all(r.release <= r.slot < r.deadline for r in rows)
    blocks = {}
    for r in rows:
        blocks.setdefault((r.source, r.block), []).append(r.position)
    for own in blocks.values():
        assert len(own) <= block_rows and max(own) - min(own) == len(own) - 1
    return blocks


@pytest.mark.parametrize("block_rows", [1, 4])
def test_shares_stay_within_one_block(spark, block_rows):
    rng = random.Random(2)
    sizes = {"hot": 900, "b": 310, "c": 77, "d": 5}
    docs = [(i, s) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    rng.shuffle(docs)
    targets = {"hot": 0.4, "b": 0.3, "c": 0.2, "d": 0.1}
    frame = spark.createDataFrame(docs, "doc_id long, source string").repartition(6)
    rows = mixing.mix(frame, targets=targets, block_rows=block_rows).collect()
    assert len({r.doc_id for r in rows}) == len(docs) == len(rows)
    check_mixture(rows, block_rows)
    weights = mixing.whole_weights(targets, mixing.PERIOD)
    first = {}
    for r in rows:
        if r.phase == 0:
            first[r.slot] = r.source
    given_out = dict.fromkeys(sizes, 0)
    for slot in range(len(first)):
        given_out[first[slot]] += 1
        for s in sizes:
            assert abs(given_out[s] - (slot + 1) * weights[s] / mixing.PERIOD) < 1


def test_query_places_every_document_once(spark):
    rows = QUERIES["op7_pfair_mix"](spark, "/root/testdata/sf0.01").collect()
    assert len({r.doc_id for r in rows}) == len(rows) == 1000
    check_mixture(rows, mixing.BLOCK_ROWS)


def test_odd_cases(spark):
    docs = odd_documents(spark)
    rows = mixing.mix(docs.select("doc_id", "source"), block_rows=2).collect()
    assert len(rows) == docs.count()
    check_mixture(rows, 2)
    ordered = mixing.in_mixture_order(docs, block_rows=2)
    assert ordered.schema == docs.schema and ordered.count() == docs.count()
    assert mixing.mix(empty_documents(spark)).count() == 0
    assert mixing.in_mixture_order(empty_documents(spark)).count() == 0
    with pytest.raises(ValueError, match="target weight"):
        mixing.mix(docs, targets={"a": 1.0})
    with pytest.raises(ValueError, match="sources"):
        mixing.mix(docs, max_sources=2)
