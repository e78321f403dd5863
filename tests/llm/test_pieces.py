import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.fixtures import empty_documents, odd_documents, table
from transferwatch.llm import pieces
from transferwatch.llm.queries import QUERIES


@pytest.fixture(scope="module")
def model():
    return pieces.PieceModel.load()


def all_segmentations(model, text):
    """Scores of every path through the whole text's lattice, in whole numbers."""
    word = (" " + text).encode()
    edges = model.edges(word)
    scores = {0: [0]}
    for end in range(1, len(word) + 1):
        scores[end] = [s + score for start, score, _ in edges[end] for s in scores.get(start, [])]
    return sorted(scores[len(word)], reverse=True)


@pytest.mark.parametrize("text", ["hello", "a", "né", "world wide", "  two", "你好!", "x\ny", "12 a"])
def test_n_best_equals_brute_force(model, text):
    found = model.n_best(text, 6)
    assert [round(s * pieces.SCALE) for s, _ in found] == all_segmentations(model, text)[:6]
    assert len({tuple(ids) for _, ids in found}) == len(found)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab théà\n▁ 你.0", min_size=1, max_size=9))
def test_any_text(model, text):
    found = model.n_best(text, 4)
    if "▁" not in text:
        assert [round(s * pieces.SCALE) for s, _ in found] == all_segmentations(model, text)[:4]
    for score, ids in found:
        data, _ = model.decode(np.array(ids), np.array([0, len(ids)]))
        assert data.tobytes().decode() == text


def test_search_alone_agrees_with_all_words_at_once(model):
    for word in [b" Verantwortung", b" " + b"z" * 60, " était".encode()]:
        data = np.frombuffer(word, dtype=np.uint8)
        score, loss, ids, _ = model.segment(data, np.array([0]), np.array([len(word)]))
        scores, _ = model.search(word, 2)
        assert (score[0], loss[0]) == (scores[0], scores[0] - scores[1])
        assert b"".join(model.pieces[i] or bytes([list(model.byte_ids).index(i)]) for i in ids) == word


def test_odd_cases(spark, model):
    docs = odd_documents(spark)
    rows = pieces.encode(docs, ["doc_id"], model).collect()
    assert len(rows) == docs.count()
    for row in rows:
        if row.doc_id == 1:
            assert row.ids is None and row.score is None
        else:
            assert row.decoded and len(row.ids) == row.n_pieces
            assert row.n_best_scores == sorted(row.n_best_scores, reverse=True)
            assert row.n_best_scores[0] == row.score
    assert {(r.n_pieces, r.score, len(r.n_best_scores)) for r in rows if r.doc_id == 2} == {(0, 0.0, 1)}
    assert pieces.encode(empty_documents(spark), ["doc_id"], model).count() == 0


def test_query_decodes_every_text(spark):
    rows = QUERIES["op2_sentencepiece_nbest"](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == 200 and all(r.decoded and len(r.n_best_scores) == 4 for r in rows)


def test_query_holds_every_segmentation(spark, model):
    texts = {d["doc_id"]: d["text"] for d in table("documents")}
    rows = QUERIES["op2_sentencepiece_nbest"](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(texts)
    for row in rows:
        options = [tuple(pieces.ids_of(row.ids, changes)) for changes in row.n_best_changes]
        assert options[0] == tuple(row.ids) and len(set(options)) == len(options) == len(row.n_best_scores)
        assert [len(ids) for ids in options] == row.n_best_pieces
        for ids in options:
            data, _ = model.decode(np.array(ids, dtype=np.int64), np.array([0, len(ids)]))
            assert data.tobytes().decode() == texts[row.doc_id]
