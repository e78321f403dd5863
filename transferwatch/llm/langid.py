"""Language identification: multinomial naive Bayes over hashed character n-grams.

Runs of one to three characters are hashed into ``2**16`` buckets. Training adds up, for each
language, how often each bucket occurs. Prediction sends one matrix of log probabilities to every
task and adds up, text by text, the rows of the buckets that occur. More than ``BLOCK_LANGUAGES``
languages are taken in blocks, one matrix after the other; what a text carries from block to block is
its best language so far, that one's log probability, and the sum of all in proportion to it.

Defined results: a null text, one without letters, or any text when nothing was learned gives
``und`` with score 0. Rows without a language teach nothing; a null id counts as not held out.
Equal scores go to the language that sorts first. Letters A-Z count as lower case.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from transferwatch.llm.arrays import Texts, byte_class, chunks, tidy
from transferwatch.llm.tables import dense_sums, gather_named, ranked, written_and_counted
from transferwatch.session import materialise

BUCKET_BITS = 16
BUCKETS = 1 << BUCKET_BITS
# The matrix that is broadcast has at most this many rows (256 KB each).
BLOCK_LANGUAGES = 256
# Languages that a task counts at once (512 KB each).
COUNTED_AT_ONCE = 64
UNDETERMINED = "und"
_LETTERS = byte_class([*range(0x41, 0x5B), *range(0x61, 0x7B)])
_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], dtype=np.uint32)


def held_out(doc_id: str | Column, parts: int = 4, part: int = 2) -> Column:
    """Whether a document is kept out of training, by a checksum of its id."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(column.cast("string")) % parts == part, F.lit(False))


def characters(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """A number for each character (its bytes), and where each text's characters start."""
    data = np.concatenate([texts.data, np.zeros(3, np.uint8)])
    following = (data & 0xC0) == 0x80
    at = np.flatnonzero(~following[:-3])
    value = data[at].astype(np.uint32)
    more = np.ones(len(at), dtype=bool)
    for k in (1, 2, 3):
        more &= following[at + k]
        if not more.any():
            break
        value |= np.where(more, data[at + k], 0).astype(np.uint32) << np.uint32(8 * k)
    return value, np.searchsorted(at, texts.offsets)


def ngram_buckets(texts: Texts) -> list[tuple[np.ndarray, np.ndarray]]:
    """For one, two and three characters: the buckets, and where each text's buckets start."""
    value, first = characters(texts)
    out = []
    lengths = np.diff(first)
    total = np.zeros(len(value), dtype=np.uint32)
    for size in (1, 2, 3):
        keep = max(len(value) - size + 1, 0)
        total = total[:keep] * np.uint32(31) + value[size - 1 :] * _FACTORS[size - 1]
        hashed = total * np.uint32(0x2C1B3C6D)
        hashed ^= hashed >> np.uint32(15)
        buckets = ((hashed * np.uint32(0x297A2D39)) >> np.uint32(32 - BUCKET_BITS)).astype(np.int32)
        inside = np.ones(keep, dtype=bool)
        for back in range(1, size):  # runs that reach into the next text are none
            ends = first[1:] - back
            inside[ends[(ends >= 0) & (ends < keep)]] = False
        starts = np.concatenate([[0], np.cumsum(np.maximum(lengths - size + 1, 0))])
        out.append((buckets if size == 1 else buckets[inside], starts))
    return out


def has_letter(texts: Texts) -> np.ndarray:
    owner_sums = np.concatenate([[0], np.cumsum(_LETTERS[texts.data])])
    found = np.diff(owner_sums[texts.offsets]) > 0
    beyond = np.diff(np.concatenate([[0], np.cumsum(texts.data >= 0x80)])[texts.offsets]) > 0
    for i in np.flatnonzero(~found & beyond):
        raw = texts.data[texts.offsets[i] : texts.offsets[i + 1]].tobytes()
        found[i] = any(c.isalpha() for c in raw.decode(errors="replace"))
    return found


def segment_sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sum of each run of ``values`` between neighbouring ``starts``; 0 for an empty run."""
    out = np.zeros(len(starts) - 1)
    full = np.flatnonzero(np.diff(starts) > 0)
    if len(full):
        out[full] = np.add.reduceat(values, starts[full], dtype=np.float64)
    return out


@dataclass(frozen=True)
class LanguageModel:
    """Languages in sorted order, their log priors, and log probabilities by language and bucket."""

    languages: list[str]
    priors: np.ndarray
    matrix: np.ndarray

    def best(self, texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each text's best language by number, its log probability, and the sum of all divided by that one."""
        n = len(texts)
        grams = ngram_buckets(texts)
        joint = np.empty((len(self.languages), n))
        for i, row in enumerate(self.matrix):
            joint[i] = self.priors[i] + sum(segment_sums(row[b], starts) for b, starts in grams)
        best = joint.argmax(axis=0)
        top = joint[best, np.arange(n)]
        return best, top, np.exp(joint - top).sum(axis=0)


@dataclass(frozen=True)
class Learned:
    """Counts of all languages as tables: ``sums`` by language and piece, ``ranks`` of the languages."""

    sums: DataFrame
    ranks: DataFrame
    languages: int
    texts: float
    block: int

    def models(self) -> Iterator[LanguageModel]:
        """The languages in sorted order, a block at a time."""
        for first in range(0, self.languages, self.block):
            chosen = self.ranks.where(F.col("_rank").between(first, first + self.block - 1)).select("name")
            counts = gather_named(self.sums.join(F.broadcast(chosen), "name"), BUCKETS + 1)
            languages = sorted(counts)
            table = np.array([counts[name] for name in languages])
            grams, texts = table[:, :BUCKETS] + 1, table[:, BUCKETS]
            matrix = np.log(grams / grams.sum(axis=1, keepdims=True)).astype(np.float32)
            yield LanguageModel(languages, np.log(texts / self.texts), matrix)


def fit(docs: DataFrame, block: int = BLOCK_LANGUAGES) -> Learned:
    """Count n-grams by language over all rows of ``docs (text, lang)`` that have both."""
    rows = docs.where("lang is not null and text is not null").select("lang", "text")
    width = BUCKETS + 1

    def count(batches):
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column("lang").dictionary_encode()
            names, index = langs.dictionary.to_pylist(), langs.indices.to_numpy(zero_copy_only=False)
            for part, texts in chunks(batch, "text", lower=True):
                grams = ngram_buckets(texts)
                for low in range(0, len(names), COUNTED_AT_ONCE):
                    own = index[part].astype(np.int64) - low
                    size = min(COUNTED_AT_ONCE, len(names) - low)
                    inside = (own >= 0) & (own < size)
                    found = np.zeros(size * width)
                    for buckets, starts in grams:
                        lengths = np.diff(starts)
                        keys = np.repeat(own * width, lengths) + buckets
                        keys = keys if inside.all() else keys[np.repeat(inside, lengths)]
                        found += np.bincount(keys, minlength=len(found))
                    found += np.bincount(own[inside] * width + BUCKETS, minlength=len(found))  # documents
                    for i in np.unique(own[inside]):
                        add, name = found[i * width : (i + 1) * width], names[low + i]
                        totals[name] = totals[name] + add if name in totals else add.copy()
                    if len(totals) > COUNTED_AT_ONCE:
                        yield totals
                        totals = {}
        yield totals

    sums = materialise(dense_sums(rows, count))
    # The last number of a language's counts is that of its texts, in a piece of its own.
    texts = sums.where(F.col("piece") == BUCKETS // 4096).select("name", F.col("total")[BUCKETS % 4096].alias("n"))
    ranks, languages = written_and_counted(ranked(texts, ["name"]))
    total = ranks.agg(F.sum("n")).first()[0] if languages else 0.0
    return Learned(sums, ranks.select("name", "_rank"), languages, total, block)


_SO_FAR = "doc_id long, held_out boolean, lang_pred string, top double, rest double"


def predict(docs: DataFrame, learned: Learned) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` for every row of ``docs (doc_id, held_out, text)``."""
    spark = docs.sparkSession
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "held_out",
        "text",
        F.lit(None).cast("string").alias("lang_pred"),
        F.lit(float("-inf")).alias("top"),
        F.lit(0.0).alias("rest"),
    )
    blocks = -(-learned.languages // learned.block)
    for number, model in enumerate(learned.models(), 1):
        schema = _SO_FAR if number == blocks else f"{_SO_FAR}, text string"
        step = one_block(spark.sparkContext.broadcast(model), [c.split()[0] for c in schema.split(", ")])
        rows = rows.mapInArrow(tidy(step), schema)
        if number < blocks:
            rows = materialise(rows)
    known = F.col("lang_pred").isNotNull()
    return rows.select(
        "doc_id",
        "held_out",
        F.coalesce("lang_pred", F.lit(UNDETERMINED)).alias("lang_pred"),
        F.when(known, 1 / F.col("rest")).otherwise(0.0).alias("score"),
    )


def one_block(sent, columns: list[str]):
    """Compare what texts carry with the languages of one more block; texts without a letter get none."""

    def run(batches):
        model = sent.value
        names = pa.array(model.languages, pa.string())
        for batch in batches:
            for rows, texts in chunks(batch, "text", lower=True):
                part = batch.slice(rows.start, len(texts))
                best, top, rest = model.best(texts)
                old_top, old_rest = (part.column(c).to_numpy() for c in ("top", "rest"))
                better, highest = top > old_top, np.maximum(top, old_top)
                rest = rest * np.exp(top - highest) + old_rest * np.exp(old_top - highest)
                named = pa.compute.if_else(pa.array(better), names.take(pa.array(best)), part.column("lang_pred"))
                named = pa.compute.if_else(pa.array(has_letter(texts)), named, pa.scalar(None, pa.string()))
                found = {"lang_pred": named, "top": pa.array(highest), "rest": pa.array(rest)}
                yield pa.RecordBatch.from_arrays([found[c] if c in found else part.column(c) for c in columns], columns)

    return run


def identify(docs: DataFrame, block: int = BLOCK_LANGUAGES) -> DataFrame:
    """Learn from the documents not held out, then predict all of them."""
    rows = docs.select("doc_id", "text", "lang").withColumn("held_out", held_out("doc_id"))
    return predict(rows, fit(rows.where(~F.col("held_out")), block))
