import random
import re

import numpy as np

from tests.llm.fixtures import empty_documents, lower, odd_documents, table
from transferwatch.llm import licenses
from transferwatch.llm.arrays import Texts
from transferwatch.llm.queries import QUERIES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(lower(text))


def brute(text):
    own, starts, base, labels, best = words(text), [], set(), set(), 0.0
    for phrase, label in licenses.PHRASES.items():
        parts = phrase.split()
        for i in range(len(own) - len(parts) + 1):
            if own[i : i + len(parts)] == parts:
                starts.append(i)
                base.add(label)
                best = 1.0
    runs = 0
    for label, template, needs, without in licenses.TEMPLATES:
        size, tokens = len(words(template)), set(words(template))
        reach, matched = size if size < 5 else 2 * size, False
        for start in range(len(own)):
            block = set(own[start : start + reach])
            common = len(tokens & block)
            match = 100 * common >= 80 * len(tokens) and block >= set(needs.split()) and not block & set(without.split())
            if match:
                labels.add(label)
                best = max(best, common / len(tokens))
            runs += match and not matched
            matched = match
    joined = ",".join
    return (
        len(own),
        len(starts),
        min(starts, default=None),
        max(starts, default=None),
        joined(sorted(base)),
        joined(sorted(base | labels)),
        round(best, 9),
        runs,
    )


def flat(row):
    return (
        row.n_words,
        row.n_base,
        row.first_word,
        row.last_word,
        row.base_labels,
        row.labels,
        round(row.score, 9),
        row.n_blocks,
    )


def test_query_equals_brute_force(spark):
    texts = {d["doc_id"]: d["text"] for d in table("documents", "0.01")}
    for row in QUERIES["op5_license_scan"](spark, "/root/testdata/sf0.01").collect():
        assert flat(row) == brute(texts[row.doc_id])


def test_damaged_templates_equal_brute_force(spark):
    rng = random.Random(3)
    filler = [f"w{i}" for i in range(30)] + ["the", "of", "license", "version", "by", "under"]
    docs = []
    for i in range(120):
        own = rng.choices(filler, k=rng.randrange(0, 120))
        for _ in range(2):
            notice = words(rng.choice(licenses.TEMPLATES).text)
            for _ in range(rng.randrange(6)):
                notice[rng.randrange(len(notice))] = rng.choice(filler)
            at = rng.randrange(len(own) + 1)
            own[at:at] = notice
        docs.append((i, " ".join(own)))
    rows = licenses.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sum(r.labels != r.base_labels for r in rows) > 20
    for row in rows:
        assert flat(row) == brute(docs[row.doc_id][1])


def labels_of(texts):
    scanner = licenses.Scanner(licenses.PHRASES, licenses.TEMPLATES, licenses.THRESHOLD)
    raw = [t.encode() for t in texts]
    ends = np.cumsum([0, *map(len, raw)])
    return scanner.scan(Texts(np.frombuffer(b"".join(raw), np.uint8), ends, lower=True))["labels"]


def test_a_notice_is_found_wherever_it_starts():
    notice = words("This work is licensed under the GNU General Public License, version 3")
    spread = [w for word in notice for w in (word, "filler")][:-1]
    texts = [" ".join(["x"] * k + spread + ["y"] * 40) for k in range(2 * len(spread))]
    assert labels_of(texts) == ["gpl-3.0"] * len(texts)


def test_sister_licenses_are_told_apart():
    expected = {
        "Licensed under CC BY 4.0": "cc-by",
        "Licensed under CC BY-NC 4.0": "cc-by,cc-by-nc",
        "Released under the Apache License": "apache",
        "This work is licensed under the GNU General Public License, version 2": "gpl",
        "This work is licensed under the GNU Lesser General Public License, version 3": "",
        licenses.TEMPLATES[7].text: "gpl",
        licenses.TEMPLATES[8].text: "lgpl",
        "all the human rights reserved": "",
        "All rights reserved": "all-rights-reserved",
    }
    assert dict(zip(expected, labels_of(list(expected)), strict=True)) == expected


def test_odd_cases(spark):
    docs = odd_documents(spark)
    assert sorted(map(repr, map(flat, licenses.scan(docs).collect()))) == sorted(
        repr(brute(r.text)) for r in docs.collect()
    )
    assert licenses.scan(empty_documents(spark)).count() == 0
