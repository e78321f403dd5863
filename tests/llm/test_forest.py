import math

import numpy as np
import pytest

from transferwatch.llm import forest
from transferwatch.llm.queries import QUERIES


def brute(vectors, query, k):
    own = vectors[query]
    found = sorted(
        (math.sqrt(sum((a - b) ** 2 for a, b in zip(own, v, strict=True))), i)
        for i, v in vectors.items()
        if i != query and len(v) == len(own)
    )
    return found[:k]


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_query_recall_and_scores(spark, sf):
    folder = f"/root/testdata/sf{sf}"
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    vectors = {r.vec_id: [float(x) for x in r.embedding] for r in rows}
    found = {}
    for r in QUERIES["op8_prefix_forest"](spark, folder).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.score, r.vec_id))
    assert set(found) == {i for i in vectors if i % 100 == 0}
    hits = 0
    for query, own in found.items():
        own.sort()
        assert [r for r, _, _ in own] == list(range(1, 11))
        assert [(s, i) for _, s, i in own] == sorted((s, i) for _, s, i in own)
        truth = brute(vectors, query, 10)
        exact = dict((i, d) for d, i in brute(vectors, query, len(vectors)))
        assert all(abs(exact[i] - s) < 1e-12 for _, s, i in own)
        hits += len({i for _, i in truth} & {i for _, _, i in own})
    assert hits >= 0.9 * 10 * len(found)


def test_forest_descends_to_the_longest_prefix():
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(500, 8))
    made = forest.Forest(vectors, trees=3, bits=10)
    chosen = list(made.candidates(vectors[:5], 20))
    for q, own in enumerate(chosen):
        longest = np.zeros(500, dtype=int)
        for normals, cuts, _, _ in made.trees:
            codes = made.strings(vectors @ normals > cuts)
            other = codes ^ codes[q]
            longest = np.maximum(longest, 10 - np.array([int(x).bit_length() for x in other]))
        depth = max(d for d in range(11) if (longest >= d).sum() >= 20)
        assert set(own) == set(np.flatnonzero(longest >= depth))


def test_copies_ties_and_what_takes_no_part(spark):
    rows = [(i, [1.0, 0.0]) for i in range(40)] + [(40, [0.0, 1.0]), (41, [0.0, 1.0])]
    rows += [(50, None), (51, [0.0, 0.0]), (52, [1.0, None]), (53, [float("nan"), 1.0]), (54, [float("inf"), 1.0])]
    rows += [(55, []), (None, [1.0, 0.0]), (60, [1.0, 2.0, 3.0]), (0, [1.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, vector array<float>")
    asked = frame.where("vec_id in (0, 5, 40, 50, 51, 52, 60)")
    found = {}
    for r in forest.nearest(frame, asked).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.vec_id, round(r.score, 9)))
    assert found[0] == [(i, 0.0) for i in range(1, 11)]
    assert found[5] == [(i, 0.0) for i in range(11) if i != 5]
    assert found[40] == [(41, 0.0)] + [(i, round(math.sqrt(2), 9)) for i in range(9)]
    assert set(found) == {0, 5, 40}
    assert forest.nearest(frame.where("false"), asked).count() == 0
    assert forest.nearest(frame, asked.where("false")).count() == 0
