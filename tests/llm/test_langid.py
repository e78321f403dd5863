import math
import random
import zlib
from collections import Counter

import numpy as np

from tests.llm.fixtures import empty_documents, lower, odd_documents
from transferwatch.llm import langid
from transferwatch.llm.queries import QUERIES


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op4_language_id"](spark, sf).collect()
    assert len(rows) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    out = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in out) >= 0.98 * len(out)
    assert all(0 <= r.score <= 1 for r in rows)


def test_counts_equal_brute_force(spark):
    docs = [("en", "ab é"), ("en", "b"), ("fr", "éa"), (None, "zz"), ("fr", None)]
    frame = spark.createDataFrame(docs, "lang string, text string")
    [model] = langid.fit(frame).models()
    assert model.languages == ["en", "fr"]
    # Characters, pairs and triples: 4 + 3 + 2 and 1 for en, 2 + 1 for fr.
    counts = [9 + 1, 3]
    for i, grams in enumerate(counts):
        smallest = model.matrix[i].min()
        assert abs(smallest - -math.log(grams + langid.BUCKETS)) < 1e-5
        assert abs(np.exp(model.matrix[i]).sum() - 1) < 1e-3


def grams(text):
    """Buckets of the runs of one to three characters, worked out with plain numbers."""
    values = [int.from_bytes(c.encode(), "little") for c in lower(text)]
    out = []
    for size in (1, 2, 3):
        for i in range(len(values) - size + 1):
            total = 0
            for k, factor in enumerate((0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)[:size]):
                total = (total * 31 + values[i + k] * factor) & 0xFFFFFFFF
            hashed = (total * 0x2C1B3C6D) & 0xFFFFFFFF
            hashed ^= hashed >> 15
            out.append(((hashed * 0x297A2D39) & 0xFFFFFFFF) >> 16)
    return out


def brute(docs):
    """Language and posterior of each text by naive Bayes with dictionaries."""
    taught = [(d, lang, text) for d, lang, text in docs if lang and text is not None and zlib.crc32(str(d).encode()) % 4 != 2]
    counts, texts = {}, Counter(lang for _, lang, _ in taught)
    for _, lang, text in taught:
        counts.setdefault(lang, Counter()).update(grams(text))
    out = {}
    for d, _, text in docs:
        if not any(c.isalpha() for c in text or ""):
            out[d] = ("und", 0.0)
            continue
        joint = {}
        for lang in sorted(counts):
            whole = counts[lang].total() + langid.BUCKETS
            likely = sum(math.log((counts[lang][g] + 1) / whole) for g in grams(text))
            joint[lang] = math.log(texts[lang] / len(taught)) + likely
        best = max(joint, key=joint.get)
        out[d] = (best, 1 / sum(math.exp(v - joint[best]) for v in joint.values()))
    return out


def test_prediction_equals_brute_force_in_any_blocks(spark):
    rng = random.Random(4)
    letters = "abcdefghijklmnop éß你好żж"
    docs = []
    for i in range(400):
        lang = rng.randrange(90)
        text = "".join(rng.choices(letters[lang % 19 : lang % 19 + 6] + "XYZ", k=rng.randrange(0, 12)))
        docs.append((i, rng.choice([f"l{lang:02}", None]) if i % 9 == 0 else f"l{lang:02}", text if i % 50 else None))
    frame = spark.createDataFrame(docs, "doc_id long, lang string, text string").repartition(3)
    expected = brute(docs)
    for block in (256, 40, 7):
        rows = langid.identify(frame, block).collect()
        assert len(rows) == len(docs)
        for r in rows:
            lang, score = expected[r.doc_id]
            assert abs(r.score - score) < 1e-4
            assert r.lang_pred == lang or score < 0.51


def test_more_languages_than_one_matrix_holds(spark):
    docs = [(i, f"l{i % 300}", f"w{i % 300} " * 5) for i in range(600)]
    expected = brute(docs)
    rows = langid.identify(spark.createDataFrame(docs, "doc_id long, lang string, text string")).collect()
    assert len(rows) == len(docs)
    for r in rows:
        lang, score = expected[r.doc_id]
        assert abs(r.score - score) < 1e-4
        assert r.lang_pred == lang or score < 0.51


def test_odd_cases(spark):
    rows = langid.identify(odd_documents(spark)).collect()
    undetermined = {r.doc_id for r in rows if r.lang_pred == "und"}
    assert undetermined == {1, 2, 3, 4}
    assert all(r.score == 0 for r in rows if r.lang_pred == "und")
    assert {r.held_out for r in rows if r.doc_id is None} == {False}
    assert langid.identify(empty_documents(spark)).count() == 0
    nothing = odd_documents(spark).selectExpr("doc_id", "text", "cast(null as string) as lang")
    assert {r.lang_pred for r in langid.identify(nothing).collect()} == {"und"}
