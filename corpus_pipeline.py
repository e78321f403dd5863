"""From raw documents to token ids: the stages of the corpus pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from transferwatch.llm import jaccard, mixing, pieces, pii, quality
from transferwatch.llm.queries import ready
from transferwatch.llm.tables import read
from transferwatch.session import materialise

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or read unlike trusted ones go."""
    ready(spark)
    return quality.fit(docs, read(spark, sf_dir, "labels")).keep(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one of smallest id."""
    ready(spark)
    return jaccard.one_of_each(docs)


def pii_pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced; ``n_chars`` follows."""
    ready(spark)
    return pii.protect(docs, length="n_chars")


def pfair_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents, their rows written in the order of the mixture."""
    ready(spark)
    return mixing.in_mixture_order(docs)


def sentencepiece_nbest(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with the scores of its best segmentations and its place in the mixture."""
    ready(spark)
    placed = mixing.with_positions(docs)
    return pieces.encode(placed, ["doc_id", "lang", "source", "position"])


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("pii_pseudonyms", pii_pseudonyms),
    ("pfair_mix", pfair_mix),
    ("sentencepiece_nbest", sentencepiece_nbest),
]

# Sketches, keyed permutations and lattices have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each one's result is written and read again."""
    docs = read(ready(spark), sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir))
    return docs
