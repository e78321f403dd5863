"""Quality rules: likelihood ratio of hashed n-grams between a trusted and the whole corpus.

Words and pairs of words are hashed into ``2**16`` buckets. Two multinomials are counted over the
buckets, one from trusted documents and one from all. A document's score is the mean, over its
n-grams, of ``log(p_trusted / p_all)``. It is kept if the score reaches a fixed threshold and the
base rules do not fail; the same text always gets the same verdict.

Defined results: a null or empty text has no words, score 0, and fails the base rules. Without
trusted documents all ratios are 0, so only the base rules count. Null ids are never trusted.
Repeated rows are measured one by one. Other columns play no part, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transferwatch.llm.arrays import Texts, byte_class, chunks, mix, sums_by, tidy, windows
from transferwatch.llm.tables import dense_sums, gather, narrow

BUCKET_BITS = 16
BUCKETS = 1 << BUCKET_BITS
# Trusted documents that the trusted multinomial is fitted on, those of smallest hashed id.
MAX_TRUSTED = 20_000
# Virtual n-grams per bucket that the corpora agree on: what rare buckets say counts little, so
# documents whose words are rare are not judged by chance, however small the corpus is.
PRIOR = 20
# Mean log ratio, in nats per n-gram, below which a document goes.
THRESHOLD = -0.08
# Fixed values of the base rules.
MIN_WORDS = 20
REPEAT_WINDOW = 8
MAX_REPEAT_PERCENT = 30
SYMBOLS = byte_class(b"#*$%&|<>")
NOT_NEWLINE = ~byte_class(b"\n")

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long,"
    " n_repeat_words long, base_failed boolean, kept boolean, llr double"
)


def ngram_buckets(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and owner of each word and each pair of neighbouring words."""
    words = texts.words()
    hashes, owner = words.hashes(), words.owner
    pairs, first = windows(hashes, owner, 2)
    buckets = np.concatenate([hashes, pairs]) >> np.uint64(64 - BUCKET_BITS)
    return buckets.astype(np.int64), np.concatenate([owner, owner[first]])


def repeated(hashes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Which of the hashes occur at least twice with the same owner."""
    keys = mix(hashes + owner.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
    ordered = np.sort(keys)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return np.zeros(len(keys), dtype=bool)
    return twice[np.minimum(np.searchsorted(twice, keys), len(twice) - 1)] == keys


def measure(texts: Texts) -> dict[str, np.ndarray]:
    """The base counts of each text."""
    n = len(texts)
    words = texts.words()
    hashes, owner = words.hashes(), words.owner

    def per_text(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags)])
        return np.diff(sums[texts.offsets])

    within = np.zeros(len(texts.data) + 1, dtype=np.int8)
    within[words.starts] += 1
    within[words.ends] -= 1
    inside = np.cumsum(within[:-1], dtype=np.int8).astype(bool)
    leading = (texts.data & 0xC0) != 0x80

    runs, first = windows(hashes, owner, REPEAT_WINDOW)
    again = first[repeated(runs, owner[first])]
    cover = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(cover, again, 1)
    np.add.at(cover, again + REPEAT_WINDOW, -1)
    covered = np.cumsum(cover[:-1]) > 0

    lines = texts.words(NOT_NEWLINE)
    with_word = np.searchsorted(words.starts, lines.ends) > np.searchsorted(words.starts, lines.starts)
    line_owner, line_hashes = lines.owner[with_word], lines.hashes()[with_word]
    keys = mix(line_hashes + line_owner.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
    _, kept = np.unique(keys, return_index=True)
    distinct = sums_by(line_owner[kept], None, n)
    return {
        "n_words": words.counts,
        "word_chars": per_text(inside & leading),
        "n_symbols": per_text(SYMBOLS[texts.data]),
        "n_dup_lines": sums_by(line_owner, None, n) - distinct,
        "n_repeat_words": sums_by(owner[covered], None, n),
    }




@dataclass(frozen=True)
class QualityRules:
    """Fitted ratios per bucket, ready to judge documents."""

    ratios: np.ndarray
    threshold: float = THRESHOLD

    def judge(self, texts: Texts) -> dict[str, np.ndarray]:
        out = measure(texts)
        buckets, owner = ngram_buckets(texts)
        grams = sums_by(owner, None, len(texts))
        total = sums_by(owner, self.ratios[buckets], len(texts))
        out["llr"] = np.divide(total, grams, out=np.zeros(len(texts)), where=grams > 0)
        out["base_failed"] = (out["n_words"] < MIN_WORDS) | (
            100 * out["n_repeat_words"] > MAX_REPEAT_PERCENT * out["n_words"]
        )
        out["kept"] = ~out["base_failed"] & (out["llr"] >= self.threshold)
        return out

    def score(self, docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
        """Counts, score and verdict of every document."""
        rules = docs.sparkSession.sparkContext.broadcast(self)
        names = [c.split()[0] for c in SCHEMA.split(", ")]

        def run(batches):
            for batch in batches:
                for rows, texts in chunks(batch, "text"):
                    found = rules.value.judge(texts)
                    ids = batch.column("doc_id").slice(rows.start, len(texts)).cast(pa.int64())
                    kinds = {"base_failed": pa.bool_(), "kept": pa.bool_(), "llr": pa.float64()}
                    yield pa.RecordBatch.from_arrays(
                        [ids, *[pa.array(found[c]).cast(kinds.get(c, pa.int64())) for c in names[1:]]], names
                    )

        columns = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
        return columns.mapInArrow(tidy(run), SCHEMA)

    def keep(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """The documents that pass, with all their columns."""
        rules = docs.sparkSession.sparkContext.broadcast(self)

        def run(batches):
            for batch in batches:
                for rows, texts in chunks(batch, text):
                    part = batch.slice(rows.start, len(texts))
                    yield part.filter(pa.array(rules.value.judge(texts)["kept"]))

        return docs.mapInArrow(tidy(run), docs.schema)


def count_ngrams(docs: DataFrame) -> DataFrame:
    def count(batches):
        total = np.zeros(BUCKETS)
        for batch in batches:
            for _, texts in chunks(batch, "text"):
                total += np.bincount(ngram_buckets(texts)[0], minlength=BUCKETS)
        return {"grams": total}

    return dense_sums(narrow(docs, "text"), count)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    threshold: float = THRESHOLD,
    max_trusted: int = MAX_TRUSTED,
) -> QualityRules:
    """Count both multinomials: all of ``docs``, and those that ``labels`` give quality 1.

    The trusted one is fitted on at most ``max_trusted`` labelled documents, so the list of their
    ids is bounded. Both get ``PRIOR`` virtual n-grams in every bucket, on the trusted corpus's scale.
    """
    ids = narrow(labels, "doc_id", "quality").where("quality = 1 and doc_id is not null")
    ids = ids.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_trusted)
    trusted = narrow(docs, "doc_id", "text").join(F.broadcast(ids), "doc_id", "left_semi")
    raw = gather(count_ngrams(docs), {"grams": BUCKETS})["grams"]
    good = gather(count_ngrams(trusted), {"grams": BUCKETS})["grams"]
    if not good.any():
        return QualityRules(np.zeros(BUCKETS), threshold)
    expected = raw * (good.sum() / raw.sum())
    return QualityRules(np.log((good + PRIOR) / (expected + PRIOR)), threshold)
