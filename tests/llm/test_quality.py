from collections import Counter

from tests.llm.fixtures import empty_documents, odd_documents, table, words
from transferwatch.llm import quality
from transferwatch.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def brute(text):
    own = words(text)
    runs = [tuple(own[i : i + 8]) for i in range(len(own) - 7)]
    seen = Counter(runs)
    covered = {i + k for i, r in enumerate(runs) if seen[r] > 1 for k in range(8)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return (
        len(own),
        sum(map(len, own)),
        sum(c in "#*$%&|<>" for c in text or ""),
        len(lines) - len(set(lines)),
        len(covered),
    )


def base_of(row):
    return (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words)


def test_query_counts_as_brute_force(spark):
    texts = {d["doc_id"]: d["text"] for d in table("documents")}
    rows = QUERIES["op1_quality_rules"](spark, SF).collect()
    assert len(rows) == len(texts)
    for row in rows:
        assert base_of(row) == brute(texts[row.doc_id])
        failed = row.n_words < 20 or 100 * row.n_repeat_words > 30 * row.n_words
        assert row.base_failed == failed
        assert row.kept == (not failed and row.llr >= quality.THRESHOLD)


def test_junk_goes_and_clean_stays(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = quality.fit(docs, labels).score(docs).join(labels, "doc_id").where("not base_failed").collect()
    good = [r.kept for r in rows if r.quality == 1]
    bad = [r.kept for r in rows if r.quality == 0]
    assert sum(good) >= 0.998 * len(good)
    assert sum(bad) <= 0.05 * len(bad)


def test_odd_cases(spark):
    docs = odd_documents(spark)
    labels = spark.createDataFrame([(8, 1), (None, 1), (2, None)], "doc_id long, quality int")
    rules = quality.fit(docs, labels)
    rows = rules.score(docs).collect()
    assert Counter(base_of(r) for r in rows) == Counter(brute(d.text) for d in docs.collect())
    kept = rules.keep(docs)
    assert kept.schema == docs.schema
    assert kept.count() == sum(r.kept for r in rows) > 0


def test_no_documents_or_no_trusted_ones(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.fit(empty_documents(spark), labels).score(empty_documents(spark)).count() == 0
    rows = quality.fit(odd_documents(spark), labels).score(odd_documents(spark)).collect()
    assert all(r.llr == 0 and r.kept == (not r.base_failed) for r in rows)
