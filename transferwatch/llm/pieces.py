"""SentencePiece encoding and decoding with the N best segmentations.

The pieces of a public model span a lattice over each text, scored like a unigram model: a piece of
merge rank ``r`` has a probability in proportion to ``1 / (1 + r)``. Scores are whole numbers
(``1 / SCALE`` nats), so sums are exact and equal scores are equal.

No piece reaches over the start of a word, so a text's lattice is a chain of words' lattices. For
every distinct word of a batch, forward and backward Viterbi scores give the best segmentation and
the loss of the second best, all words of a length at once. A text's N best segmentations differ
from its best one only at the ``N - 1`` words of smallest loss (any other change has that many
better ones). For those words a backward A* search runs over the lattice: the forward Viterbi
scores are exact heuristics, so paths come out in order, and the agenda never needs more than the
paths still wanted. The choices are then combined best first.

Characters without a piece become byte pieces, so decoding gives every text back as it was.

Defined results: a null text gives nulls, an empty one no pieces, score 0 and one segmentation.
Equal scores keep the order the search finds them in, which depends on the text alone. Texts are
encoded whole. Other columns play no part.
"""

from __future__ import annotations

import bisect
import heapq
import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from transferwatch.llm.arrays import _BYTE_VALUES, _powers, chunks, mix, tidy

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
N_BEST = 4
SCALE = 10_000
# Text handled at once: more bytes share more words.
TEXT_CHUNK = 2 << 20
# Words a task remembers from one run of texts to the next.
REMEMBERED = 400_000
# Longer words are searched one by one.
LONGEST_WORD = 48
_BLOCK = 20_000
_LOW = np.int64(-(1 << 40))
_SLOT_BITS = 21
_SPACE = 0x20


def raw_hashes(sums: np.ndarray, down: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix((sums[ends] - sums[starts]) * down[starts])


def running_sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE_VALUES[data] * up[: len(data)], out=sums[1:])
    return sums, down


def spans(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers ``begin .. begin + size - 1`` of every pair, one after the other."""
    origin = np.repeat(begin - np.cumsum(size) + size, size)
    return origin + np.arange(len(origin))


@dataclass
class Word:
    """The best segmentations of one word, best first: ids and loss against the best."""

    ids: list[tuple[int, ...]]
    losses: list[int]


class PieceModel:
    """Pieces as bytes (a space for the word mark), their whole-number scores, and byte pieces."""

    def __init__(self, pieces: list[bytes | None], ranks: list[float], byte_ids: list[int]):
        self.pieces = pieces
        usable = [i for i, p in enumerate(pieces) if p]
        total = sum(1 / (1 + ranks[i]) for i in usable)
        self.scores = np.zeros(len(pieces), dtype=np.int64)
        for i in usable:
            self.scores[i] = round(SCALE * -math.log((1 + ranks[i]) * total))
        self.byte_ids = np.array(byte_ids, dtype=np.int32)
        self.byte_score = int(min(self.scores[usable]))
        self.index = {pieces[i]: i for i in usable}
        self.longest = max(len(pieces[i]) for i in usable)
        if any(b" " in p.lstrip(b" ") for p in self.index):
            raise ValueError("pieces must not reach over the start of a word")
        # ASCII bytes that no longer piece holds part words as well.
        held = set(b"".join(p for p in self.index if len(p) > 1))
        self.breakers = np.array([b < 0x80 and b not in held for b in range(256)])
        self._slots()
        self._text_table()
        self.words: dict[bytes, Word] = {}
        self.memory = None

    @classmethod
    def load(cls, path: str = MODEL_PATH) -> PieceModel:
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        pieces, ranks, byte_ids = [], [], [0] * 256
        for i in range(model.get_piece_size()):
            name = model.id_to_piece(i)
            if model.is_byte(i):
                byte_ids[int(name[1:-1], 16)] = i
                pieces.append(None)
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                pieces.append(None)
            else:
                pieces.append(name.replace("▁", " ").encode())
            ranks.append(-model.get_score(i))
        return cls(pieces, ranks, byte_ids)

    def forget(self) -> None:
        """Drop the words remembered so far."""
        self.words.clear()
        self.memory = None

    def _slots(self) -> None:
        """Tables from hash to id: what collides in the first stands in the second, and so on."""
        ids = np.array([self.index[p] for p in self.index], dtype=np.int32)
        data = np.frombuffer(b"".join(self.index), dtype=np.uint8)
        ends = np.cumsum([len(p) for p in self.index])
        sums, down = running_sums(data)
        hashes = raw_hashes(sums, down, ends - [len(p) for p in self.index], ends)
        self.piece_hash = np.zeros(len(self.pieces) + 1, dtype=np.uint64)
        self.piece_hash[ids] = hashes
        self.tables = []
        shift = 64 - _SLOT_BITS
        while len(ids):
            table = np.full(1 << _SLOT_BITS, len(self.pieces), dtype=np.int32)
            slot = (hashes >> np.uint64(shift)).astype(np.int64)
            table[slot] = ids
            self.tables.append((shift, table))
            left = table[slot] != ids
            ids, hashes, shift = ids[left], hashes[left], shift - _SLOT_BITS
            hashes = hashes & np.uint64((1 << (shift + _SLOT_BITS)) - 1) if shift > 0 else hashes

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        """Id of the piece with each hash, -1 if there is none."""
        found = np.full(len(hashes), -1, dtype=np.int32)
        mask = np.uint64((1 << _SLOT_BITS) - 1)
        for shift, table in self.tables:
            ids = table[((hashes >> np.uint64(shift)) & mask).astype(np.int64)]
            hit = self.piece_hash[ids] == hashes
            found[hit] = ids[hit]
        return found

    def _text_table(self) -> None:
        parts = [p or b"" for p in self.pieces]
        for value, i in enumerate(self.byte_ids):
            parts[i] = bytes([value])
        lengths = np.array([len(p) for p in parts])
        self.text_bytes = np.frombuffer(b"".join(parts), dtype=np.uint8)
        self.text_starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        self.text_lengths = lengths

    # One word at a time

    def edges(self, word: bytes) -> list[list[tuple[int, int, tuple[int, ...]]]]:
        """For each end, the pieces that end there: start, score, ids."""
        n = len(word)
        ending: list[list] = [[] for _ in range(n + 1)]
        start = 0
        while start < n:
            stop = start + 1
            while stop < n and word[stop] & 0xC0 == 0x80:
                stop += 1
            if word[start:stop] not in self.index:
                ids = tuple(int(self.byte_ids[b]) for b in word[start:stop])
                ending[stop].append((start, self.byte_score * len(ids), ids))
            for end in range(stop, min(n, start + self.longest) + 1):
                if (piece := self.index.get(word[start:end])) is not None:
                    ending[end].append((start, int(self.scores[piece]), (piece,)))
            start = stop
        return ending

    def search(self, word: bytes, n_best: int) -> tuple[list[int], list[tuple[int, ...]]]:
        """Scores and ids of the ``n_best`` segmentations, best first."""
        ending = self.edges(word)
        forward: list[int | None] = [0] + [None] * len(word)
        for end in range(1, len(word) + 1):
            into = [forward[s] + score for s, score, _ in ending[end] if forward[s] is not None]
            forward[end] = max(into) if into else None
        # Agenda: (minus the full score, number, place reached, score so far, pieces behind it).
        agenda = [(-forward[len(word)], 0, len(word), 0, None)]
        scores, paths, number = [], [], 0
        while agenda and len(paths) < n_best:
            total, _, place, behind, chain = agenda.pop(0)
            if place == 0:
                scores.append(-total)
                ids: list[int] = []
                while chain is not None:
                    ids.extend(chain[0])
                    chain = chain[1]
                paths.append(tuple(ids))
                continue
            for start, score, ids in ending[place]:
                if forward[start] is None:
                    continue
                number += 1
                item = (-(forward[start] + score + behind), number, start, score + behind, (ids, chain))
                bisect.insort(agenda, item, key=lambda x: x[:2])
            del agenda[n_best - len(paths) :]
        return scores, paths

    def best_of(self, word: bytes, n_best: int) -> Word:
        known = self.words.get(word)
        if known is None:
            scores, paths = self.search(word, n_best)
            known = Word(paths, [scores[0] - s for s in scores])
            if len(self.words) >= 50_000:
                self.words.clear()
            self.words[word] = known
        return known

    # All words of a batch

    def segment(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        """Best segmentation of each word ``data[start:end]``.

        Returns the score, the second best's loss (a huge one if there is no second), and the ids
        one word after the other with their offsets.
        """
        n = len(starts)
        score, loss = np.zeros(n, np.int64), np.full(n, -_LOW)
        pieces: list[np.ndarray] = []
        owners: list[np.ndarray] = []
        lengths = ends - starts
        sums, down = running_sums(data)
        order = np.argsort(lengths, kind="stable")
        cuts = np.flatnonzero(np.diff(lengths[order])) + 1
        for group in np.split(order, cuts):
            size = int(lengths[group[0]]) if len(group) else 0
            if not size:
                continue
            if size > LONGEST_WORD:
                for i in group.tolist():
                    scores, paths = self.search(data[starts[i] : ends[i]].tobytes(), 2)
                    score[i] = scores[0]
                    if len(scores) > 1:
                        loss[i] = scores[0] - scores[1]
                    pieces.append(np.array(paths[0], dtype=np.int32))
                    owners.append(np.full(len(paths[0]), i))
                continue
            for at in range(0, len(group), _BLOCK):
                some = group[at : at + _BLOCK]
                found = self._same_length(data, sums, down, starts[some], size)
                score[some], loss[some] = found[0], found[1]
                pieces.append(found[2])
                owners.append(some[found[3]])
        if not pieces:
            return score, loss, np.empty(0, np.int32), np.zeros(n + 1, np.int64)
        ids, owner = np.concatenate(pieces), np.concatenate(owners)
        back = np.argsort(owner, kind="stable")
        offsets = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))])
        return score, loss, ids[back], offsets

    def _recall(self, data, hashes, starts, ends, times):
        """As ``segment``, for words of known sorted hashes; repeated words are remembered."""
        if self.memory is None or len(self.memory[0]) > REMEMBERED:
            none = np.empty(0, np.int64)
            self.memory = (np.empty(0, np.uint64), none, none, np.empty(0, np.int32), np.zeros(1, np.int64))
        known, m_score, m_loss, m_ids, m_first = self.memory
        at = np.searchsorted(known, hashes)
        hit = np.zeros(len(hashes), dtype=bool)
        if len(known):
            hit = known[np.minimum(at, len(known) - 1)] == hashes
        new = np.flatnonzero(~hit)
        n_score, n_loss, n_ids, n_first = self.segment(data, starts[new], ends[new])
        # All words, old ones first, then in the order of their hashes.
        all_hashes = np.concatenate([known, hashes[new]])
        score, loss = np.concatenate([m_score, n_score]), np.concatenate([m_loss, n_loss])
        ids = np.concatenate([m_ids, n_ids])
        begin = np.concatenate([m_first[:-1], n_first[:-1] + len(m_ids)])
        size = np.concatenate([np.diff(m_first), np.diff(n_first)])
        where = np.empty(len(hashes), dtype=np.int64)
        where[hit] = at[hit]
        where[new] = len(known) + np.arange(len(new))
        keep = np.concatenate([np.ones(len(known), dtype=bool), times[new] > 1])
        kept = np.flatnonzero(keep)
        kept = kept[np.argsort(all_hashes[kept], kind="stable")]
        first = np.concatenate([[0], np.cumsum(size[kept])])
        self.memory = (all_hashes[kept], score[kept], loss[kept], ids[spans(begin[kept], size[kept])], first)
        first = np.concatenate([[0], np.cumsum(size[where])])
        return score[where], loss[where], ids[spans(begin[where], size[where])], first

    def _same_length(self, data, sums, down, starts, size):
        count = len(starts)
        rows = starts[:, None] + np.arange(size)
        letters = data[rows]
        lead = (letters & 0xC0) != 0x80
        lead[:, 0] = True
        # Bytes of the character that starts at each place (0 inside one).
        width = np.zeros((count, size), dtype=np.int64)
        nearest = np.full(count, size)
        for i in range(size - 1, -1, -1):
            width[:, i] = np.where(lead[:, i], nearest - i, 0)
            nearest = np.where(lead[:, i], i, nearest)
        reach = min(size, max(self.longest, int(width.max())))
        ids, scores = [], []
        for step in range(1, reach + 1):
            at = rows[:, : size - step + 1]
            hashes = mix(((sums[at + step] - sums[at]) * down[at]).ravel())
            piece = self.lookup(hashes).reshape(at.shape)
            value = np.where(piece >= 0, self.scores[piece], _LOW)
            bare = (width[:, : size - step + 1] == step) & (piece < 0)
            value[bare] = self.byte_score * step
            piece[bare] = -2
            ids.append(piece)
            scores.append(value)
        forward = np.full((size + 1, count), _LOW)
        forward[0] = 0
        via = np.zeros((size + 1, count), dtype=np.int64)
        for end in range(1, size + 1):
            for step in range(1, min(end, reach) + 1):
                total = forward[end - step] + scores[step - 1][:, end - step]
                better = total > forward[end]
                forward[end][better] = total[better]
                via[end][better] = step
        backward = np.full((size + 1, count), _LOW)
        backward[size] = 0
        for start in range(size - 1, -1, -1):
            for step in range(1, min(size - start, reach) + 1):
                np.maximum(
                    backward[start], backward[start + step] + scores[step - 1][:, start], out=backward[start]
                )
        taken = np.zeros((count, size), dtype=np.int64)
        place, each = np.full(count, size), np.arange(count)
        while (open_ := place > 0).any():
            step = via[place[open_], each[open_]]
            place[open_] -= step
            taken[each[open_], place[open_]] = step
        second = np.full(count, _LOW)
        for step in range(1, reach + 1):
            for start in range(size - step + 1):
                total = forward[start] + scores[step - 1][:, start] + backward[start + step]
                total[taken[:, start] == step] = _LOW
                np.maximum(second, total, out=second)
        best = forward[size]
        loss = np.where(second > _LOW // 2, best - second, -_LOW)
        who, where = np.nonzero(taken)
        steps = taken[who, where]
        piece = np.empty(len(who), dtype=np.int32)
        for step in range(1, reach + 1):
            same = steps == step
            piece[same] = ids[step - 1][who[same], where[same]]
        bare = piece == -2
        if bare.any():
            copies = np.where(bare, steps, 1)
            first = np.cumsum(copies) - copies
            origin = np.repeat(np.arange(len(who)), copies)
            offset = np.arange(len(origin)) - first[origin]
            piece = np.where(bare[origin], self.byte_ids[letters[who[origin], where[origin] + offset]], piece[origin])
            who = who[origin]
        return best, loss, piece.astype(np.int32), who

    def encode(self, data: np.ndarray, offsets: np.ndarray, n_best: int) -> dict:
        """Segment a run of texts: best ids with offsets, and the scores of the N best.

        ``changes`` has for each text and option what differs from the best ids: from which place
        on, how many of them, and the ids instead.
        """
        n = len(offsets) - 1
        filled = np.diff(offsets) > 0
        marks = offsets[:-1][filled]
        data = np.insert(data, marks, _SPACE)  # the word mark every text starts with
        offsets = offsets + np.concatenate([[0], np.cumsum(filled)])
        space, breaker = data == _SPACE, self.breakers[data]
        begins = np.zeros(len(data), dtype=bool)
        if len(data):
            begins[1:] = (space[1:] & ~space[:-1]) | breaker[1:] | breaker[:-1]
            begins[offsets[:-1][filled]] = True
        starts = np.flatnonzero(begins)
        ends = np.append(starts[1:], len(data)) if len(starts) else starts
        sums, down = running_sums(data)
        hashes = raw_hashes(sums, down, starts, ends)
        distinct, sample, word, times = np.unique(
            hashes, return_index=True, return_inverse=True, return_counts=True
        )
        score, loss, ids, first = self._recall(data, distinct, starts[sample], ends[sample], times)
        text_first = np.searchsorted(starts, offsets)
        sizes = np.diff(first)[word]
        all_ids = ids[spans(first[:-1][word], sizes)]
        word_at = np.concatenate([[0], np.cumsum(sizes)])
        id_offsets = word_at[text_first]
        word_score, word_loss = score[word], loss[word]
        totals = np.concatenate([[0], np.cumsum(word_score)])
        totals = totals[text_first[1:]] - totals[text_first[:-1]]
        options, words, changes = [], [], []
        for i in range(n):
            a, b = int(text_first[i]), int(text_first[i + 1])
            if n == 1:
                words.append([ids[first[w] : first[w + 1]] for w in word[a:b]])
            options.append(self._combine(data, starts, ends, word_loss, a, b, n_best, lambda w: ids[first[w] : first[w + 1]], word))
            changes.append(
                [
                    [(int(word_at[a + p] - word_at[a]), int(sizes[a + p]), list(new)) for p, new in changed]
                    for _, _, changed in options[-1]
                ]
            )
        return {"ids": all_ids, "offsets": id_offsets, "scores": totals, "options": options, "words": words, "changes": changes}

    def _combine(self, data, starts, ends, loss, a, b, n_best, best, word) -> list[tuple[int, int, list]]:
        """The N smallest losses of a text, the pieces they add, and the changed words.

        A changed word is its number in the text and its ids.
        """
        span = loss[a:b]
        keep = n_best - 1
        if len(span) > keep:
            limit = np.partition(span, keep - 1)[keep - 1] if keep else -1
            near = np.flatnonzero(span < limit)
            tied = np.flatnonzero(span == limit)[: keep - len(near)]
            near = np.sort(np.concatenate([near, tied]))
        else:
            near = np.arange(len(span))
        near = [int(p) for p in near if span[p] < -_LOW]
        words = [self.best_of(data[starts[a + p] : ends[a + p]].tobytes(), n_best) for p in near]
        if any(w.losses[1] != span[p] for w, p in zip(words, near, strict=True)):
            raise AssertionError("search and Viterbi disagree")
        choices = []
        for p, w in zip(near, words, strict=True):  # of equal segmentations the text's own comes first
            found, own = list(w.ids), tuple(best(word[a + p]).tolist())
            if own in found:
                found[found.index(own)] = found[0]
            choices.append([own, *found[1:]])
        heap = [(0, ())]
        out = []
        while heap and len(out) < n_best:
            total, changes = heapq.heappop(heap)
            extra = sum(len(choices[w][c]) - len(choices[w][0]) for w, c in changes)
            out.append((total, extra, [(near[w], choices[w][c]) for w, c in changes]))
            last = changes[-1][0] if changes else -1
            if changes:  # the next choice for the last changed word
                w, c = changes[-1]
                if c + 1 < len(words[w].losses):
                    step = words[w].losses[c + 1] - words[w].losses[c]
                    heapq.heappush(heap, (total + step, (*changes[:-1], (w, c + 1))))
            for w in range(last + 1, len(words)):
                if len(words[w].losses) > 1:
                    heapq.heappush(heap, (total + words[w].losses[1], (*changes, (w, 1))))
        return out

    def n_best(self, text: str, n_best: int = N_BEST) -> list[tuple[float, list[int]]]:
        """Score and ids of the best segmentations of one text, best first."""
        data = np.frombuffer(text.encode(), dtype=np.uint8)
        got = self.encode(data, np.array([0, len(data)]), n_best)
        words = got["words"][0]
        out = []
        for loss, _, changes in got["options"][0]:
            ids = [list(w) for w in words]
            for place, changed in changes:
                ids[place] = list(changed)
            out.append(((int(got["scores"][0]) - loss) / SCALE, [i for w in ids for i in w]))
        return out

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The texts' bytes and their offsets, without the word mark each starts with."""
        lengths = self.text_lengths[ids]
        data = self.text_bytes[spans(self.text_starts[ids], lengths)]
        at = np.concatenate([[0], np.cumsum(lengths)])[offsets]
        filled = np.diff(at) > 0
        return np.delete(data, at[:-1][filled]), at - np.concatenate([[0], np.cumsum(filled)])


ENCODED = "ids array<int>, n_pieces long, score double, n_best_scores array<double>, n_best_pieces array<long>, n_best_changes array<array<struct<at:int,size:int,ids:array<int>>>>, ids_crc32 long, decoded boolean"


def ids_of(ids: list[int], changes: list[tuple[int, int, list[int]]]) -> list[int]:
    """The ids of one of the N best, from those of the best and its ``n_best_changes``."""
    out = list(ids)
    for at, size, new in sorted(changes, reverse=True):
        out[at : at + size] = new
    return out


def encode(
    docs: DataFrame, keep: list[str], model: PieceModel | None = None, n_best: int = N_BEST, text: str = "text"
) -> DataFrame:
    """The columns ``keep`` with each text's ids, score, and scores and sizes of its N best.

    ``n_best_changes`` turns the ids into those of each of the N best (``ids_of``). ``ids_crc32`` is the checksum of the ids as little-endian 32-bit numbers; ``decoded`` says
    that decoding the ids gives the text back byte by byte.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model or PieceModel.load())
    kept = [docs.schema[c] for c in keep]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [ENCODED])
    names = keep + [c.split()[0] for c in ENCODED.split(", ")]
    change = pa.struct([("at", pa.int32()), ("size", pa.int32()), ("ids", pa.list_(pa.int32()))])

    def run(batches):
        model = sent.value
        for batch in batches:
            for rows, texts in chunks(batch, text, limit=TEXT_CHUNK):
                size = len(texts)
                got = model.encode(texts.data, texts.offsets, n_best)
                data, at = model.decode(got["ids"], got["offsets"])
                bare = batch.column(text).slice(rows.start, size).is_null().to_numpy(zero_copy_only=False)
                first = got["offsets"]
                same, crc, best, counts = [], [], [], []
                whole = np.array_equal(at, texts.offsets) and np.array_equal(data, texts.data)
                for i in range(size):
                    a, b = first[i], first[i + 1]
                    crc.append(zlib.crc32(got["ids"][a:b].astype("<i4").tobytes()))
                    same.append(
                        whole
                        or np.array_equal(
                            data[at[i] : at[i + 1]], texts.data[texts.offsets[i] : texts.offsets[i + 1]]
                        )
                    )
                    options = got["options"][i]
                    best.append([(int(got["scores"][i]) - loss) / SCALE for loss, _, _ in options])
                    counts.append([int(b - a) + extra for _, extra, _ in options])
                lists = pa.ListArray.from_arrays(
                    pa.array(first.astype(np.int32)), pa.array(got["ids"], pa.int32())
                )
                columns = [
                    lists,
                    pa.array(np.diff(first), pa.int64()),
                    pa.array(got["scores"] / SCALE, pa.float64()),
                    pa.array(best, pa.list_(pa.float64())),
                    pa.array(counts, pa.list_(pa.int64())),
                    pa.array(
                        [
                            [[{"at": at, "size": n, "ids": new} for at, n, new in option] for option in options]
                            for options in got["changes"]
                        ],
                        pa.list_(pa.list_(change)),
                    ),
                    pa.array(crc, pa.int64()),
                    pa.array(same, pa.bool_()),
                ]
                empty = pa.array(bare)
                columns = [pc.if_else(empty, pa.scalar(None, c.type), c) for c in columns]
                own = [batch.column(c).slice(rows.start, size) for c in keep]
                yield pa.RecordBatch.from_arrays(own + columns, names)

    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(tidy(run, lambda: sent.value.forget()), schema)
