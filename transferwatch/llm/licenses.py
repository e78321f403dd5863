"""License scans: phrases word by word, and templates by exact set containment.

Base labels come from places where a phrase's words stand one after the other. The method's labels
come from a set-similarity join between blocks of text and license templates: a block matches when
it holds at least ``THRESHOLD`` of a template's distinct words, all words that tell the license from
its sisters (``needs``) and none that belongs to a sister only (``without``). Blocks of a template of
``m`` words are all runs of ``2 m`` words, wherever they start (of ``m`` words for templates of fewer
than five: so few words mean something only together).

The join is exact. Words are ordered by how often they occur in all documents, rarest first. A
block that matches must hold one of the first ``|T| - ceil(t |T|) + 1`` words of the template
(prefix filter), the text must have enough words (length filter), and only words that share a block
with one of those first words are looked at (positional filter). The distinct words of all blocks
around such places are counted at once: a word counts for the starts from which a block reaches it
and not the same word before it, so counts are running sums over where these ranges begin and end.

Defined results: null and empty texts have no words, no labels and score 0. A repeated row is
scanned again. The score is the largest containment of a matching block, 1 if a phrase is found.
``n_blocks`` counts, over templates, the unbroken runs of starts whose blocks match.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from transferwatch.llm.arrays import ALPHANUMERIC, Texts, Words, chunks, tidy
from transferwatch.llm.tables import dense_sums, gather, narrow

# Phrases of the base labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}


class Notice(NamedTuple):
    """A template's label and text, the words a block must hold and those it must not."""

    label: str
    text: str
    needs: str = ""
    without: str = ""


# Notices that licenses ask for, or their opening words.
TEMPLATES = [
    Notice("apache-2.0", "Licensed under the Apache License, Version 2.0", "apache 2"),
    Notice("apache-2.0", "you may not use this file except in compliance with the License", "compliance license"),
    Notice("mit", "Released under the MIT License", "mit"),
    Notice("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "obtaining"),
    Notice("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "fee"),
    Notice("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "redistribution"),
    Notice("gpl-3.0", "This work is licensed under the GNU General Public License, version 3", "gnu general 3", "lesser affero"),
    Notice("gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "gnu general", "lesser affero"),
    Notice("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "lesser"),
    Notice("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "mozilla 2"),
    Notice("cc-by-nc", "Licensed under CC BY-NC 4.0", "nc"),
    Notice("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License", "attribution", "noncommercial"),
    Notice("unlicense", "This is free and unencumbered software released into the public domain", "unencumbered"),
    Notice("all-rights-reserved", "All rights reserved"),
]
# Share of a template's distinct words that a block must hold.
THRESHOLD = 0.8
# Templates of fewer words are looked for in blocks of their own length.
SHORT = 5
SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string,"
    " labels string, score double, n_blocks long"
)


def as_words(texts: list[str]) -> Words:
    """The words of some texts, lower case."""
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    return Texts(np.frombuffer(b"".join(raw), dtype=np.uint8), offsets, lower=True).words(ALPHANUMERIC)


def split(words: Words, values: np.ndarray) -> list[np.ndarray]:
    return np.split(values, words.first[1:-1])


def near(places: np.ndarray, hits: np.ndarray, reach: int) -> np.ndarray:
    """Which sorted places are fewer than ``reach`` words from one of the sorted ``hits``."""
    if not len(hits):
        return np.zeros(len(places), dtype=bool)
    after = np.searchsorted(hits, places)
    right = hits[np.minimum(after, len(hits) - 1)]
    left = hits[np.maximum(after - 1, 0)]
    return (np.abs(right - places) < reach) | (np.abs(left - places) < reach)


@dataclass
class Template:
    label: str
    block: int
    tokens: np.ndarray
    need: int
    needed: np.ndarray
    unwanted: np.ndarray
    prefix: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))


class Scanner:
    """Phrases and templates as numbers, with the templates' words in global order."""

    def __init__(self, phrases: dict[str, str], templates: list[Notice], threshold: float):
        self.labels = sorted({*phrases.values(), *(t.label for t in templates)})
        spoken = as_words(list(phrases))
        self.phrases = list(zip(phrases.values(), split(spoken, spoken.hashes()), strict=True))
        written = as_words([text for t in templates for text in (t.text, t.needs, t.without)])
        hashes = written.hashes()
        self.vocabulary = np.unique(hashes)
        places = split(written, np.searchsorted(self.vocabulary, hashes))
        self.templates = []
        for i, notice in enumerate(templates):
            own, needed, unwanted = places[3 * i : 3 * i + 3]
            tokens = np.unique(own)
            if not np.isin(needed, tokens).all() or np.isin(unwanted, tokens).any():
                raise ValueError(f"{notice.label}: words needed must be the template's own, unwanted ones not")
            block = len(own) * (1 if len(own) < SHORT else 2)
            need = math.ceil(round(threshold * len(tokens), 9))
            self.templates.append(Template(notice.label, block, tokens, need, np.unique(needed), np.unique(unwanted)))
        self.order_by(np.zeros(len(self.vocabulary)))

    def order_by(self, frequency: np.ndarray) -> None:
        """Fix each template's prefix: its words that are rarest in the corpus."""
        rank = np.lexsort((self.vocabulary, frequency)).argsort()
        for t in self.templates:
            ordered = t.tokens[np.argsort(rank[t.tokens])]
            t.prefix = ordered[: len(ordered) - t.need + 1]

    def known(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each word in the templates' vocabulary, or one past it."""
        size = len(self.vocabulary)
        if not size:
            return np.zeros(len(hashes), dtype=np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), size - 1)
        return np.where(self.vocabulary[at] == hashes, at, size)

    def phrase_places(self, hashes: np.ndarray, owner: np.ndarray) -> list[tuple[str, np.ndarray]]:
        out = []
        for label, phrase in self.phrases:
            at = np.flatnonzero(hashes[: max(len(hashes) - len(phrase) + 1, 0)] == phrase[0])
            for k in range(1, len(phrase)):
                at = at[(hashes[at + k] == phrase[k]) & (owner[at + k] == owner[at])]
            out.append((label, at))
        return out

    def matching_blocks(
        self, words: Words, known: np.ndarray
    ) -> list[tuple[str, np.ndarray, np.ndarray]]:
        """Per template: its label, the texts of its runs of matching blocks, and their best containment."""
        owner, out = words.owner, []
        size = len(self.vocabulary) + 1
        for t in self.templates:
            kind = np.zeros(size, dtype=np.int8)
            kind[t.tokens], kind[t.unwanted], kind[t.prefix] = 1, 1, 2
            places = np.flatnonzero(kind[known])
            hits = places[kind[known[places]] == 2]
            hits = hits[words.counts[owner[hits]] >= t.need]
            places = places[near(places, hits, t.block)]
            out.append((t.label, *self.runs(t, places, words, known)))
        return out

    @staticmethod
    def runs(t: Template, places: np.ndarray, words: Words, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Texts and best containment of the runs of starts whose blocks match, from the template's words."""
        tokens, text = known[places], words.owner[places]
        by_word = np.lexsort((places, tokens, text))
        before = np.full(len(places), -1)
        same = (tokens[by_word[1:]] == tokens[by_word[:-1]]) & (text[by_word[1:]] == text[by_word[:-1]])
        before[by_word[1:][same]] = places[by_word[:-1][same]]
        start = np.maximum(np.maximum(places - t.block + 1, before + 1), words.first[text])
        # Three counts in one number: words of the template, words needed, words unwanted.
        weight = np.where(np.isin(tokens, t.unwanted), 1 << 40, 1 + (np.isin(tokens, t.needed) << 20))
        at = np.concatenate([start, places + 1])
        order = np.argsort(at, kind="stable")
        at, change = at[order], np.concatenate([weight, -weight])[order]
        last = np.flatnonzero(np.append(at[1:] != at[:-1], len(at) > 0))
        at, held = at[last], np.cumsum(change)[last]
        common = held & 0xFFFFF
        good = (common >= t.need) & (held >> 20 == len(t.needed))
        # Runs end where a block does not match and where a text ends.
        of_text = words.owner[np.minimum(at, max(len(words.owner) - 1, 0))] if len(at) else at
        begins = good & ~np.append(False, good[:-1] & (of_text[1:] == of_text[:-1]))[: len(good)]
        starts = np.flatnonzero(begins)
        if not len(starts):
            return np.empty(0, np.int64), np.empty(0)
        best = np.maximum.reduceat(np.where(good, common, 0), starts)
        return of_text[starts], best / len(t.tokens)

    def scan(self, texts: Texts) -> dict[str, list | np.ndarray]:
        n = len(texts)
        words = texts.words(ALPHANUMERIC)
        hashes, owner = words.hashes(), words.owner
        base = np.zeros((len(self.labels), n), dtype=bool)
        all_labels = base.copy()
        n_base, score, n_blocks = np.zeros(n, np.int64), np.zeros(n), np.zeros(n, np.int64)
        first, last = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
        for label, at in self.phrase_places(hashes, owner):
            base[self.labels.index(label), owner[at]] = True
            n_base += np.bincount(owner[at], minlength=n)
            np.minimum.at(first, owner[at], at - words.first[owner[at]])
            np.maximum.at(last, owner[at], at - words.first[owner[at]])
        score[n_base > 0] = 1.0
        for label, found, share in self.matching_blocks(words, self.known(hashes)):
            all_labels[self.labels.index(label), found] = True
            n_blocks += np.bincount(found, minlength=n)
            np.maximum.at(score, found, share)
        none = n_base == 0
        return {
            "n_words": words.counts,
            "n_base": n_base,
            "first_word": np.ma.array(first, mask=none),
            "last_word": np.ma.array(last, mask=none),
            "base_labels": self.joined(base),
            "labels": self.joined(base | all_labels),
            "score": score,
            "n_blocks": n_blocks,
        }

    def joined(self, flags: np.ndarray) -> list[str]:
        out = [""] * flags.shape[1]
        for i in np.flatnonzero(flags.any(axis=0)).tolist():
            out[i] = ",".join(label for label, on in zip(self.labels, flags[:, i], strict=True) if on)
        return out


def word_frequencies(docs: DataFrame, scanner: Scanner) -> np.ndarray:
    """How often each template word occurs in all documents."""
    size = len(scanner.vocabulary)

    def count(batches):
        total = np.zeros(size)
        for batch in batches:
            for _, texts in chunks(batch, "text", lower=True):
                known = scanner.known(texts.words(ALPHANUMERIC).hashes())
                total += np.bincount(known, minlength=size + 1)[:size]
        return {"words": total}

    return gather(dense_sums(narrow(docs, "text"), count), {"words": size})["words"]


def scan(
    docs: DataFrame,
    phrases: dict[str, str] = PHRASES,
    templates: list[Notice] = TEMPLATES,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """Base and template labels of every row of ``docs (doc_id, text)``."""
    scanner = Scanner(phrases, templates, threshold)
    scanner.order_by(word_frequencies(docs, scanner))
    sent = docs.sparkSession.sparkContext.broadcast(scanner)
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches):
        kinds = {"base_labels": pa.string(), "labels": pa.string(), "score": pa.float64()}
        for batch in batches:
            for rows, texts in chunks(batch, "text", lower=True):
                found = sent.value.scan(texts)
                ids = batch.column("doc_id").slice(rows.start, len(texts)).cast(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [ids, *[as_column(found[c], kinds.get(c, pa.int64())) for c in names[1:]]], names
                )

    return narrow(docs, "doc_id", "text").mapInArrow(tidy(run), SCHEMA)


def as_column(values: list | np.ndarray, kind: pa.DataType) -> pa.Array:
    mask = np.ma.getmaskarray(values) if isinstance(values, np.ma.MaskedArray) else None
    return pa.array(np.asarray(values) if mask is not None else values, kind, mask=mask)
