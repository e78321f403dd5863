"""Chat formatting in budgeted windows: training texts with loss masks, which can be read back.

Turns are written as ``<|im_start|>role``, a newline, the text and ``<|im_end|>`` with a newline. A turn that does not
fit the window with those before it starts a new window. Prefix sums of the turns' tokens give, by one
binary search each, the last turn a window can hold and the first turn of the history it repeats. Every
window after the first begins with the system turn and up to ``HISTORY_TURNS`` turns of at most
``HISTORY_TOKENS`` tokens from just before its own. The loss mask covers the texts of the window's own
assistant turns; repeated ones are not covered, so each is learned once.

Control strings inside texts are escaped: one backslash more goes between ``<`` and ``|``, whatever number of
them was there, so no text can open or close a turn, and taking one away restores it. In roles,
backslashes and newlines are escaped besides.

Windows do not cross multiples of ``RUN_TURNS`` turns of a conversation, so a long one is formatted by many
tasks; each gets the system turn and the history it repeats. A task holds the texts of at most that many turns.

Defined cases. A null role or text is empty. Rows go by turn, nulls first, and rows of equal turn by a digest of
role and text; all are formatted, repeated ones too. A system turn is the first row if its role
is ``system``. A turn that is longer than the budget is kept whole in a window of its own, after the
system turn; history gives way first. Null conversation ids are one conversation. Further columns are ignored. An empty
table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from transferwatch.llm.arrays import tidy
from transferwatch.llm.tables import narrow, ranked
from transferwatch.operators.skew import join_same
from transferwatch.session import materialise

# Ranks of a public tokenizer, which counts the tokens.
TOKENIZER_PATH = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# Fixed values.
# How that tokenizer cuts texts into words.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
START, END = "<|im_start|>", "<|im_end|>\n"
SYSTEM, LEARNED = "system", "assistant"
# Tokens that the marks of a turn count for.
MARKS = 3

BUDGET = 512
HISTORY_TOKENS = 128
HISTORY_TURNS = 4
RUN_TURNS = 256

_OPENING = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")
_ROLE_ESCAPED = re.compile(r"\\(.)")


def escape(text: str) -> str:
    return _OPENING.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return _ROLE_ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


@dataclass(frozen=True)
class Limits:
    """How long windows and their history may be, in tokens and turns."""

    budget: int = BUDGET
    history_tokens: int = HISTORY_TOKENS
    history_turns: int = HISTORY_TURNS


@lru_cache(maxsize=2)
def _tokenizer(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("windows", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})


def token_counts(texts: list[str], path: str) -> list[int]:
    encode = _tokenizer(path).encode_ordinary
    return [len(encode(text)) for text in texts]


def spans(
    tokens: list[int], first: int, system: int | None, limits: Limits
) -> list[tuple[int, int, int]]:
    """``(history, start, end)``: windows own turns ``start`` to ``end`` and repeat those from ``history``.

    ``tokens`` holds the turns lent by the run before and then the run's own, which start at ``first``.
    ``system`` is the number of tokens of a system turn to repeat; None if the first turn is one or there is none.
    """
    sums = np.concatenate([[0], np.cumsum(tokens)])
    found, start = [], first
    opening = system is None  # the first window of a conversation has nothing to repeat
    while start < len(tokens):
        room = limits.budget - (0 if opening else system or 0)
        # The earliest turn whose history fits its own limits, and leaves room for the next turn.
        spare = min(limits.history_tokens, room - tokens[start])
        back = int(np.searchsorted(sums, sums[start] - max(spare, 0), side="left"))
        history = min(max(back, start - limits.history_turns), start)
        end = int(np.searchsorted(sums, sums[history] + room, side="right")) - 1
        end = min(max(end, start + 1), len(tokens))
        found.append((history, start, end))
        start, opening = end, False
    return found


def windows(
    rows: DataFrame,
    limits: Limits = Limits(),
    tokenizer: str = TOKENIZER_PATH,
    run_turns: int = RUN_TURNS,
) -> DataFrame:
    """``(conv_id, first, n_repeated, n_turns, tokens, text, loss)`` of every window.

    ``first`` is the place of the window's first own turn in the conversation, ``n_repeated`` how many
    turns come before it in the text, ``loss`` the masked-in spans as places of code points.
    """
    if limits.history_turns > run_turns:
        raise ValueError("history cannot reach further back than a run")
    whole = narrow(rows, "conv_id", "turn", "role", "text").withColumns(
        {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text")}
    )
    said = F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    digested = whole.withColumn("_digest", F.sha2(said, 256))
    order = ["turn", "_digest"]
    turns = materialise(
        ranked(digested, order, within="conv_id", rank="place").select("conv_id", "place", "role", "text")
    )
    run, at = F.floor(F.col("place") / run_turns), F.col("place") % run_turns

    # Each run gets the last turns of the one before, and the conversation's system turn.
    lent = (at >= run_turns - limits.history_turns) & (F.col("place") >= 0)
    copies = F.when(lent, F.array(F.lit("own"), F.lit("lent"))).otherwise(F.array(F.lit("own")))
    placed = turns.withColumn("kind", F.explode(copies)).withColumn(
        "run", run + (F.col("kind") == "lent").cast("long")
    )
    later = turns.where((run > 0) & (at == 0)).select("conv_id", run.alias("run"))
    system = turns.where((F.col("place") == 0) & (F.col("role") == SYSTEM))
    repeated = join_same(later, system, ["conv_id"], "inner").withColumn("kind", F.lit("system"))
    rank = F.when(F.col("kind") == "system", -1).otherwise(F.col("place"))
    lined_up = (
        placed.unionByName(repeated)
        .withColumn("_rank", rank)
        .repartition("conv_id", "run")
        .sortWithinPartitions("conv_id", "run", "_rank")
    )
    schema = T.StructType([rows.schema["conv_id"]]).add("first", "long")
    for name in ("n_repeated", "n_turns", "tokens"):
        schema = schema.add(name, "long")
    schema = schema.add("text", "string")
    schema = schema.add("loss", T.ArrayType(T.StructType().add("start", "long").add("end", "long")))
    arrow = to_arrow_schema(schema)

    def run_all(batches):
        for made in _formatted(batches, limits, tokenizer):
            yield pa.RecordBatch.from_pylist(made, arrow)

    return lined_up.mapInArrow(tidy(run_all), schema)


def _formatted(batches, limits: Limits, tokenizer: str):
    """Windows of each run, whose turns come one after the other."""
    key, held = None, []
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "run", "kind", "place", "role", "text")]
        for conv, run, kind, place, role, text in zip(*columns, strict=True):
            if (conv, run) != key:
                yield _windows_of(key, held, limits, tokenizer)
                key, held = (conv, run), []
            held.append((kind, place, role, text))
    yield _windows_of(key, held, limits, tokenizer)


def _windows_of(key, held: list[tuple], limits: Limits, tokenizer: str) -> list[dict]:
    if not any(kind == "own" for kind, *_ in held):
        return []  # turns lent to a run that is not there
    texts = [f"{START}{escape_role(role)}\n{escape(text)}{END}" for _, _, role, text in held]
    bodies = [f"{role}\n{escape(text)}" for _, _, role, text in held]
    tokens = [n + MARKS for n in token_counts(bodies, tokenizer)]
    opens = held[0][1] == 0 and held[0][0] == "own"
    given = held[0][0] == "system"
    # The system turn, if there is one, is never part of the history: it is repeated in any case.
    own_system = opens and held[0][2] == SYSTEM
    lead = 1 if given else 0
    made = []
    first = next(i for i, h in enumerate(held) if h[0] == "own")
    if own_system:
        plans = _opening_spans(tokens, limits)
    else:
        plans = [(h + lead, s + lead, e + lead)
                 for h, s, e in spans(tokens[lead:], first - lead, None if opens else tokens[0] * lead, limits)]
    for history, start, end in plans:
        repeats = [0] if (given or own_system) and start > 0 else []
        repeats += [i for i in range(history, start) if i not in repeats]
        parts, loss, length = [], [], 0
        for i in [*repeats, *range(start, end)]:
            if i >= start and held[i][2] == LEARNED:
                begin = length + len(START) + len(escape_role(held[i][2])) + 1
                loss.append({"start": begin, "end": begin + len(escape(held[i][3]))})
            parts.append(texts[i])
            length += len(texts[i])
        made.append(
            {
                "conv_id": key[0],
                "first": held[start][1],
                "n_repeated": len(repeats),
                "n_turns": end - start,
                "tokens": sum(tokens[i] for i in [*repeats, *range(start, end)]),
                "text": "".join(parts),
                "loss": loss,
            }
        )
    return made


def _opening_spans(tokens: list[int], limits: Limits) -> list[tuple[int, int, int]]:
    """Spans of the run that holds the system turn as its first: it opens the first window."""
    if len(tokens) == 1:
        return [(0, 0, 1)]
    rest = [(h + 1, s + 1, e + 1) for h, s, e in spans(tokens[1:], 0, tokens[0], limits)]
    _, _, end = rest[0]
    return [(0, 0, end), *rest[1:]]


def turns_of(text: str) -> list[tuple[str, str, int]]:
    """Role, text and where the text starts, of each turn of a formatted window."""
    found, at = [], 0
    while at < len(text):
        line = text.index("\n", at)
        end = text.index(END, line)
        if not text.startswith(START, at):
            raise ValueError("a turn must begin with its mark")
        found.append((unescape_role(text[at + len(START) : line]), unescape(text[line + 1 : end]), line + 1))
        at = end + len(END)
    return found


def read_back(made: DataFrame) -> DataFrame:
    """What the windows hold, read from their texts and masks alone: one row per conversation.

    ``(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars)``. The windows of a
    conversation are read in order in one task, one at a time.
    """
    schema = T.StructType([made.schema["conv_id"]]).add("n_turns", "long").add("turns_sha256", "string")
    schema = schema.add("loss_chars", "long").add("loss_sha256", "string").add("formatted_chars", "long")
    arrow = to_arrow_schema(schema)

    def run(batches):
        own = None
        for batch in batches:
            out = []
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "first", "n_repeated", "text", "loss")]
            for conv, first, n_repeated, text, loss in zip(*columns, strict=True):
                if first == 0:
                    if own:
                        out.append(own.result())
                    own = _Digest(conv)
                own.add(text, n_repeated, loss)
            yield pa.RecordBatch.from_pylist(out, arrow)
        if own:
            yield pa.RecordBatch.from_pylist([own.result()], arrow)

    needed = made.select("conv_id", "first", "n_repeated", "text", "loss")
    lined_up = needed.repartition("conv_id").sortWithinPartitions("conv_id", "first")
    return lined_up.mapInArrow(tidy(run), schema)


class _Digest:
    def __init__(self, conv):
        self.conv, self.turns, self.loss_chars, self.formatted = conv, 0, 0, 0
        self.said, self.learned = hashlib.sha256(), hashlib.sha256()

    def add(self, text: str, n_repeated: int, loss: list[dict]) -> None:
        own = turns_of(text)[n_repeated:]
        for role, said, _ in own:
            self.said.update(f"{role}\n{said}\n".encode())
        for span in loss:
            part = unescape(text[span["start"] : span["end"]])
            self.loss_chars += len(part)
            self.learned.update(part.encode())
        self.turns += len(own)
        self.formatted += len(text)

    def result(self) -> dict:
        return {
            "conv_id": self.conv,
            "n_turns": self.turns,
            "turns_sha256": self.said.hexdigest(),
            "loss_chars": self.loss_chars,
            "loss_sha256": self.learned.hexdigest(),
            "formatted_chars": self.formatted,
        }
