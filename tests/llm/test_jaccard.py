import random
from collections import Counter

import pytest

from tests.llm.fixtures import empty_documents, lower, odd_documents, table, words
from transferwatch.llm import jaccard
from transferwatch.llm.queries import QUERIES


def shingles(text):
    own = words(lower(text))
    if not own:
        return frozenset()
    return frozenset(tuple(own[i : i + 5]) for i in range(max(1, len(own) - 4)))


def brute(docs):
    """``[(doc_id, set size, smallest id reachable)]`` by all pairs."""
    sets = [(d, shingles(t)) for d, t in docs]
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                parent[root(i)] = root(j)
    smallest = {}
    for i, (d, _) in enumerate(sets):
        if d is not None:
            smallest[root(i)] = min(d, smallest.get(root(i), d))
    return Counter((d, len(s), d if not s else smallest.get(root(i))) for i, (d, s) in enumerate(sets))


def found(frame):
    return Counter((r.doc_id, r.n_shingles, r.component_id) for r in frame.collect())


def chain(rng, base, steps, edits):
    """Texts that each differ a little from the one before."""
    out, own = [], list(base)
    for _ in range(steps):
        out.append(" ".join(own))
        for _ in range(edits):
            own[rng.randrange(len(own))] = f"new{rng.randrange(10**6)}"
    return out


def test_query_equals_brute_force(spark):
    docs = [(d["doc_id"], d["text"]) for d in table("documents", "0.01")]
    frame = QUERIES["op3_ngram_jaccard_join"](spark, "/root/testdata/sf0.01")
    assert found(frame) == brute(docs)


@pytest.mark.parametrize("pivots", [(1, 3), jaccard.PIVOTS])
def test_chains_and_large_groups(spark, monkeypatch, pivots):
    """Groups held together by links between members far from any single pivot."""
    monkeypatch.setattr(jaccard, "PIVOTS", pivots)
    rng = random.Random(5)
    texts = []
    for steps, edits in [(8, 1), (5, 3)]:
        base = [f"w{rng.randrange(60)}" for _ in range(110)]
        texts += chain(rng, base, steps, edits)
    base = [f"v{i}" for i in range(120)]
    for _ in range(14):  # near copies of one text, some too far from each other
        own = list(base)
        for _ in range(rng.randrange(4)):
            own[rng.randrange(len(own))] = f"u{rng.randrange(10**6)}"
        texts.append(" ".join(own))
    docs = list(enumerate(texts))
    rng.shuffle(docs)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert found(jaccard.components(frame)) == brute(docs)


def test_threshold_is_exact(spark):
    """Sets of 4 and 5 shingles that share 4 are just similar enough; 3 of 4 are not."""
    docs = [(1, "a b c d e f g h"), (2, "a b c d e f g h i"), (3, "q a b c d e f g h i j")]
    assert found(jaccard.components(spark.createDataFrame(docs, "doc_id long, text string"))) == brute(docs)


def test_odd_cases(spark):
    docs = odd_documents(spark)
    assert found(jaccard.components(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])
    left = jaccard.one_of_each(docs)
    assert left.schema == docs.schema
    assert Counter(r.doc_id for r in left.collect())[6] == 1 and left.count() == docs.count() - 1
    assert jaccard.components(empty_documents(spark)).count() == 0
    assert jaccard.one_of_each(empty_documents(spark)).count() == 0


def test_one_of_each_keeps_the_smallest(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    kept = sorted(r.doc_id for r in jaccard.one_of_each(docs).select("doc_id").collect())
    assert kept == sorted({c for _, _, c in found(jaccard.components(docs))})
