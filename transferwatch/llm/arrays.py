"""Words and their hashes for a whole Arrow batch of texts at once.

The texts of a batch lie one after the other in one byte array. Which bytes belong to words is
read from a table, a word's hash from running sums over the bytes, so no Python runs per word.
A word's hash depends on its bytes alone: it is the same in every batch, task and run.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

# Bytes of text handled at once; a longer single text is handled alone and whole.
CHUNK_BYTES = 1 << 20

_U = np.uint64
_MULTIPLIER = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit numbers over all bits (a bijection)."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def random_words(n: int, seed: int) -> np.ndarray:
    """``n`` fixed 64-bit numbers."""
    return mix((np.arange(1, n + 1, dtype=_U) + _U(seed * 1_000_003)) * _U(_MULTIPLIER))


_BYTE_VALUES = random_words(256, 1)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) <= n:
        inverse = pow(_MULTIPLIER, -1, 1 << 64)
        for name, factor in (("up", _MULTIPLIER), ("down", inverse)):
            steps = np.full(max(n, CHUNK_BYTES) + 1, factor, dtype=_U)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"][:n], _POWERS["down"]


def tidy(run: Callable, *after: Callable) -> Callable:
    """``run`` for ``mapInArrow``, leaving no working memory behind in its Python process.

    Later tasks use the process again, beside others on the same machine.
    """

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            for step in after:
                step()
            _POWERS.clear()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return whole


def byte_class(members: bytes | range | list[int]) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(members)] = True
    return table


# Words are runs of anything but ASCII white space.
NOT_SPACE = ~byte_class(b" \t\n\x0b\x0c\r")
# Words are runs of ASCII letters and digits and of anything beyond ASCII.
ALPHANUMERIC = byte_class([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


class Texts:
    """A run of texts as bytes: ``data`` and where each text starts (``offsets``, one more at the end)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool):
        self.data = LOWER[data] if lower else data
        self.offsets = offsets

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def words(self, members: np.ndarray = NOT_SPACE) -> Words:
        inside = members[self.data]
        cut = np.zeros(len(inside) + 1, dtype=bool)
        cut[self.offsets] = True
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | cut[1:-1]
        ends = inside
        ends[:-1] &= ~inside[1:] | cut[1:-1]
        return Words(self, np.flatnonzero(begins), np.flatnonzero(ends) + 1)


class Words:
    """Where the words of some texts start and end, and which words are whose."""

    def __init__(self, texts: Texts, starts: np.ndarray, ends: np.ndarray):
        self.texts, self.starts, self.ends = texts, starts, ends
        self.first = np.searchsorted(starts, texts.offsets)

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        """Words of each text."""
        return np.diff(self.first)

    @property
    def owner(self) -> np.ndarray:
        """Number of the text of each word."""
        return np.repeat(np.arange(len(self.texts)), self.counts)

    def hashes(self) -> np.ndarray:
        """One 64-bit number per word."""
        data = self.texts.data
        up, down = _powers(len(data))
        sums = np.zeros(len(data) + 1, dtype=_U)
        np.cumsum(_BYTE_VALUES[data] * up, out=sums[1:])
        return mix((sums[self.ends] - sums[self.starts]) * down[self.starts])

    def text(self, i: int) -> str:
        return self.texts.data[self.starts[i] : self.ends[i]].tobytes().decode()


def windows(hashes: np.ndarray, owner: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``size`` words that lies in one text, and the run's first word."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, _U), np.empty(0, np.int64)
    first = np.flatnonzero(owner[:n] == owner[size - 1 :])
    factors = random_words(size, 7) | _U(1)
    total = np.zeros(len(first), dtype=_U)
    for k in range(size):
        total += hashes[first + k] * factors[k]
    return mix(total), first


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of an Arrow string column as one byte array with offsets; null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(
    batch: pa.RecordBatch, column: str, lower: bool = False, limit: int = CHUNK_BYTES
) -> Iterator[tuple[slice, Texts]]:
    """The texts of a batch in runs of about ``limit`` bytes, with the rows each run covers."""
    if not batch.num_rows:
        return
    data, offsets = column_bytes(batch.column(column))
    start = 0
    while start < batch.num_rows:
        stop = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        stop = min(max(stop, start + 1), batch.num_rows)
        part = offsets[start : stop + 1]
        yield slice(start, stop), Texts(data[part[0] : part[-1]], part - part[0], lower)
        start = stop


def sums_by(owner: np.ndarray, values: np.ndarray | None, n: int) -> np.ndarray:
    """Sum of ``values`` (or the count) for each of ``n`` owners."""
    return np.bincount(owner, weights=values, minlength=n)[:n]


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as a signed number, which Spark can hold."""
    return x.view(np.int64)
