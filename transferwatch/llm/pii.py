"""Personal data: format-preserving pseudonyms from a keyed Feistel permutation.

Numbers, dates, addresses and secrets that pass the checks of their kind are replaced by others of
the same kind and layout. Each kind is a range of whole numbers; a keyed Feistel network with cycle
walking permutes that range. Equal values get equal pseudonyms in every document, different values
different ones, and whoever holds the key can turn them back (``Pseudonyms.restore``).

| Kind | Recognised by | Permuted |
|---|---|---|
| card | 13 to 19 digits, also in groups, valid check digit | all digits, check digit made anew |
| iban | two letters, valid mod-97 check | digits and letters of the account part, check made anew |
| ssn | ``ddd-dd-dddd`` with a valid area, group and serial | all three parts, within their ranges |
| phone | ``+1 (ddd) ddd-dddd`` and its usual layouts, also without the 1; + and 8 to 15 digits | all digits but the country code |
| ip | four parts up to 255 | the 32 bits |
| date | existing days 1900 to 2099 in three layouts, also before a time (``T10:00``) | the day |
| email | local part, at sign, domain | the local part's letters and digits, by class |
| secret | a value assigned to password, token, secret, key | its letters and digits, by class |

A card or iban that fails its check is tried again without its last groups, then from each later
start: a number beside it hides no value. What still fails stays as it is. Equal values get equal
pseudonyms whatever stands beside them, so in rare cases a pseudonym and digits beside it pass
a check together; such a value is turned back by ``restore`` rather than by reading the text. Null and empty texts stay as they are. Whole texts are read,
line by line, however long, in time that grows with their length: an address is looked for only where its local
part begins, and local parts and secrets of more than ``PIECE`` characters are permuted piece by piece. Other columns are handed through, whatever their names.
"""

from __future__ import annotations

import datetime
import hashlib
import math
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from transferwatch.llm.arrays import column_bytes

ROUNDS = 10
# Characters that are permuted as one number.
PIECE = 256
# For trials only: a real key comes from the caller's secret store.
DEMO_KEY = b"demonstration key, replace it"
KINDS = ("card", "iban", "ssn", "phone", "ip", "date", "email", "secret")

_FIRST_DAY = datetime.date(1900, 1, 1).toordinal()
_DAYS = datetime.date(2100, 1, 1).toordinal() - _FIRST_DAY
_ALPHABETS = (
    "0123456789",
    "abcdefghijklmnopqrstuvwxyz",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ",
    "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ",
)
_HEX = ("0123456789abcdef", "0123456789ABCDEF")
_SHAPES = (*_ALPHABETS, *_HEX)
_CLASS = {c: a for a in _ALPHABETS for c in a}

_PATTERNS = {
    "email": r"(?<![\w.%+\-])[\w.%+\-]++@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}",
    "secret": r"(?i:\b(?:password|passwd|pwd|token|secret|api[_-]?key|access[_-]?key)\b)"
    r"(?P<gap>\s*[=:]\s*[\"']?)(?P<value>[A-Za-z0-9+/_\-]{8,})",
    "iban": r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    "phone": r"(?<![\w+])(?:\+?1[ .\-]?\(?\d{3}\)?[ .\-]?\d{3}[ .\-]\d{4}(?!\d)"
    r"|(?:\(\d{3}\)[ .\-]?|\d{3}[ .\-])\d{3}[ .\-]\d{4}(?!-?\w)"
    r"|\+[1-9](?:[ .\-]?\(?\d\)?){7,14}(?!\d))",
    "date": r"(?<![\w.\-/])(?:(?P<iso>\d{4}-\d{2}-\d{2})(?=T\d\d:|(?![\w\-/]))"
    r"|(?:(?P<us>\d{2}/\d{2}/\d{4})|(?P<dot>\d{2}\.\d{2}\.\d{4}))(?![\w\-/]))",
    "ssn": r"(?<![\w\-])\d{3}-\d{2}-\d{4}(?![\w\-])",
    "ip": r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\w|\.\d)",
    "card": r"(?<!\w)\d(?:[ \-]?\d){12,18}(?!\w)",
}
_SEARCH = re.compile("|".join(f"(?P<{kind}>{pattern})" for kind, pattern in _PATTERNS.items()))
_KINDS = {kind: re.compile(pattern) for kind, pattern in _PATTERNS.items()}
# Country codes of two digits; 1 and 7 have one, all others three.
_TWO_DIGITS = {*"20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49".split()} | {
    *"51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
}
_WORTH = re.compile(r"[0-9@=:]")
_LAYOUTS = {"iso": "%Y-%m-%d", "us": "%m/%d/%Y", "dot": "%d.%m.%Y"}


def check_digit(digits: str) -> int:
    """The digit that makes a payload pass the mod-10 check."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def iban_remainder(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97


class Pseudonyms:
    """Keyed permutations of every kind, and their inverses."""

    def __init__(self, key: bytes = DEMO_KEY):
        self.key = hashlib.blake2b(key).digest()
        self._cached = lru_cache(maxsize=1 << 16)(self._one)

    def __reduce__(self):
        return _from_digest, (self.key,)

    def permute(self, value: int, size: int, kind: str, back: bool = False) -> int:
        """The number that takes the place of ``value`` among ``0 .. size - 1``."""
        if size < 2:
            return value
        side = math.isqrt(size - 1) + 1
        while True:  # the network permutes side * side numbers: walk on until one is in range
            left, right = divmod(value, side)
            for step in range(ROUNDS):
                if back:
                    turn = ROUNDS - 1 - step
                    left, right = (right - self._round(turn, left, size, kind)) % side, left
                else:
                    left, right = right, (left + self._round(step, right, size, kind)) % side
            value = left * side + right
            if value < size:
                return value

    def _round(self, turn: int, value: int, size: int, kind: str) -> int:
        text = f"{kind}|{size}|{turn}|{value}".encode()
        width = max(16, (size.bit_length() + 7) // 8 // 2 + 9)
        return int.from_bytes(hashlib.shake_256(self.key + text).digest(width))

    def replace(self, kind: str, text: str) -> str:
        return self._cached(kind, text, False)

    def restore(self, kind: str, text: str) -> str:
        return self._cached(kind, text, True)

    def _one(self, kind: str, text: str, back: bool) -> str:
        return getattr(self, f"_{kind}")(text, back)

    def _digits(self, text: str, kind: str, back: bool, fixed: int = 0) -> str:
        """Permute the digits of ``text`` after the first ``fixed``, keeping everything else."""
        digits = [c for c in text if c.isdigit()]
        rest = digits[fixed:]
        moved = self.permute(int("".join(rest)), 10 ** len(rest), kind, back)
        return _fill(text, "".join(digits[:fixed]) + str(moved).zfill(len(rest)))

    def _card(self, text: str, back: bool) -> str:
        digits = "".join(c for c in text if c.isdigit())
        moved = self.permute(int(digits[:-1]), 10 ** (len(digits) - 1), "card", back)
        payload = str(moved).zfill(len(digits) - 1)
        return _fill(text, payload + str(check_digit(payload)))

    def _phone(self, text: str, back: bool) -> str:
        digits = "".join(c for c in text if c.isdigit())
        if text[0] != "+":
            fixed = len(digits) - 10
        else:
            fixed = 1 if digits[0] in "17" else 2 if digits[:2] in _TWO_DIGITS else 3
        return self._digits(text, "phone", back, fixed)

    def _ip(self, text: str, back: bool) -> str:
        a, b, c, d = map(int, text.split("."))
        moved = self.permute((a << 24) | (b << 16) | (c << 8) | d, 1 << 32, "ip", back)
        return ".".join(str(moved >> shift & 255) for shift in (24, 16, 8, 0))

    def _ssn(self, text: str, back: bool) -> str:
        area, group, serial = map(int, text.split("-"))
        # Areas 1-899 without 666, groups 1-99, serials 1-9999.
        value = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
        moved, serial = divmod(self.permute(value, 898 * 99 * 9999, "ssn", back), 9999)
        area, group = divmod(moved, 99)
        area += 1 if area < 665 else 2
        return f"{area:03d}-{group + 1:02d}-{serial + 1:04d}"

    def _date(self, text: str, back: bool) -> str:
        layout = _LAYOUTS["iso" if text[4] == "-" else "us" if "/" in text else "dot"]
        day = datetime.datetime.strptime(text, layout).date().toordinal() - _FIRST_DAY
        moved = datetime.date.fromordinal(_FIRST_DAY + self.permute(day, _DAYS, "date", back))
        return moved.strftime(layout)

    def _iban(self, text: str, back: bool) -> str:
        plain = text.replace(" ", "")
        bare = plain[:2] + "00" + self._by_class(plain[4:], "iban" + plain[:2], back)
        checked = f"{bare[:2]}{98 - iban_remainder(bare):02d}{bare[4:]}"
        moved = iter(checked)
        return "".join(c if c == " " else next(moved) for c in text)

    def _email(self, text: str, back: bool) -> str:
        local, _, domain = text.rpartition("@")
        return f"{self._by_class(local, 'email', back)}@{domain}"

    def _secret(self, text: str, back: bool) -> str:
        return self._by_class(text, "secret", back)

    def _by_class(self, text: str, kind: str, back: bool) -> str:
        """Permute the characters that belong to a class, each within its class, all as one number."""
        if len(text) > PIECE:
            pieces = [text[i : i + PIECE] for i in range(0, len(text), PIECE)]
            return "".join(self._by_class(p, f"{kind}/{i}", back) for i, p in enumerate(pieces))
        secret = kind.startswith("secret")
        hexadecimal = next((a for a in _HEX if secret and all(c in a for c in text)), None)
        classes = [hexadecimal or _CLASS.get(c) for c in text]
        value, size = 0, 1
        for c, alphabet in zip(text, classes, strict=True):
            if alphabet:
                value = value * len(alphabet) + alphabet.index(c)
                size *= len(alphabet)
        shape = "".join(str(_SHAPES.index(a)) if a else "-" for a in classes)
        value = self.permute(value, size, f"{kind}/{shape}", back)
        out = list(text)
        for i in range(len(text) - 1, -1, -1):
            if alphabet := classes[i]:
                value, place = divmod(value, len(alphabet))
                out[i] = alphabet[place]
        return "".join(out)


def _from_digest(digest: bytes) -> Pseudonyms:
    made = Pseudonyms()
    made.key = digest
    return made


def _fill(layout: str, digits: str) -> str:
    """``layout`` with its digits replaced one by one."""
    following = iter(digits)
    return "".join(next(following) if c.isdigit() else c for c in layout)


def valid(kind: str, text: str) -> bool:
    """Whether a match passes the check of its kind."""
    if kind == "card":
        digits = "".join(c for c in text if c.isdigit())
        return digits.isascii() and check_digit(digits[:-1]) == int(digits[-1]) and int(digits) > 0
    if kind == "iban":
        return 15 <= len(plain := text.replace(" ", "")) <= 34 and iban_remainder(plain) == 1
    if kind == "ssn":
        area, group, serial = map(int, text.split("-"))
        return 0 < area < 900 and area != 666 and group > 0 and serial > 0
    if kind == "ip":
        return all(int(p) < 256 and (p == "0" or p[0] != "0") for p in text.split("."))
    if kind == "date":
        layout = _LAYOUTS["iso" if text[4] == "-" else "us" if "/" in text else "dot"]
        try:
            day = datetime.datetime.strptime(text, layout).date().toordinal() - _FIRST_DAY
        except ValueError:
            return False
        return 0 <= day < _DAYS
    return True


def value_at(line: str, at: int, first: str) -> tuple[str, int, int] | None:
    """Kind, start and stop of the value at a place: of the first kind from ``first`` on that has a valid one."""
    kinds = list(_PATTERNS)
    for kind in kinds[kinds.index(first) :]:
        if match := _KINDS[kind].match(line, at):
            start, stop = match.span("value" if kind == "secret" else 0)
            stops = [stop]
            if kind in ("card", "iban"):  # without its last groups
                stops += [i for i in range(stop - 1, start, -1) if line[i] in " -"]
            for stop in stops:
                value = line[start:stop]
                if not value.isascii() and kind not in ("email", "secret"):
                    continue
                if kind == "card" and sum(c.isdigit() for c in value) < 13:
                    break
                if valid(kind, value):
                    return kind, start, stop
    return None


def pseudonymise(text: str, names: Pseudonyms, back: bool = False) -> tuple[str, dict[str, int]]:
    """The text with its personal data replaced, and how many of each kind there were."""
    counts = dict.fromkeys(KINDS, 0)
    change = names.restore if back else names.replace

    def swap(line: str) -> str:
        out, done, at = [], 0, 0
        while match := _SEARCH.search(line, at):
            at = match.start()
            if found := value_at(line, at, next(k for k in _PATTERNS if match[k] is not None)):
                kind, start, stop = found
                counts[kind] += 1
                out += [line[done:start], change(kind, line[start:stop])]
                done = at = stop
            else:
                at += 1
        return "".join([*out, line[done:]])

    lines = text.split("\n")
    for i, line in enumerate(lines):
        if _WORTH.search(line):
            lines[i] = swap(line)
    return "\n".join(lines), counts


def worth_reading(column: pa.Array) -> np.ndarray:
    """Which texts hold a byte that every kind needs: a digit, an at sign or an assignment."""
    data, offsets = column_bytes(column)
    marks = np.zeros(256, dtype=bool)
    marks[[*b"0123456789@=:"]] = True
    sums = np.concatenate([[0], np.cumsum(marks[data])])
    return np.diff(sums[offsets]) > 0


def replace_column(column: pa.Array, names: Pseudonyms) -> tuple[pa.Array, dict[str, np.ndarray]]:
    """A column of texts with personal data replaced, and counts of each kind by row."""
    counts = {kind: np.zeros(len(column), dtype=np.int64) for kind in KINDS}
    rows = np.flatnonzero(worth_reading(column))
    changed, at = [], []
    for i in rows.tolist():
        before = column[i].as_py()
        after, found = pseudonymise(before, names)
        if after != before:
            changed.append(after)
            at.append(i)
        for kind, n in found.items():
            counts[kind][i] = n
    mask = np.zeros(len(column), dtype=bool)
    mask[at] = True
    if at:
        column = column.to_pandas()
        column[mask] = changed
        column = pa.array(column, pa.large_string(), from_pandas=True)
    return column, counts


def protect(docs: DataFrame, key: bytes = DEMO_KEY, text: str = "text", length: str | None = None) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced; all columns stay.

    ``length`` names a column with the text's length in characters, which is brought up to date.
    """
    names = docs.sparkSession.sparkContext.broadcast(Pseudonyms(key))
    schema = docs.schema

    def run(batches):
        for batch in batches:
            place = batch.schema.get_field_index(text)
            before = batch.column(place)
            after, _ = replace_column(before, names.value)
            columns = list(batch.columns)
            columns[place] = after.cast(before.type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    out = docs.mapInArrow(run, schema)
    if length:
        kind = schema[length].dataType
        new = F.when(F.col(text).isNotNull(), F.length(text).cast(kind)).otherwise(F.col(length))
        out = out.withColumn(length, new)
    return out


def report(docs: DataFrame, key: bytes = DEMO_KEY) -> DataFrame:
    """``(doc_id, text, n_card, n_iban, ...)``: the protected text and what was replaced in it."""
    names = docs.sparkSession.sparkContext.broadcast(Pseudonyms(key))

    def run(batches):
        for batch in batches:
            after, counts = replace_column(batch.column("text"), names.value)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), after.cast(pa.string()), *[pa.array(counts[k]) for k in KINDS]],
                ["doc_id", "text", *[f"n_{k}" for k in KINDS]],
            )

    schema = "doc_id long, text string, " + ", ".join(f"n_{k} long" for k in KINDS)
    return docs.select("doc_id", "text").mapInArrow(run, schema)
