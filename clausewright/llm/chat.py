"""Chat formatting in budgeted, turn-aligned windows.

The turns of a conversation are read in order as a stream (rows are dealt by
conversation and sorted, never gathered), so one conversation may hold any
number of turns: what is kept in memory is its system turn, the limited
history and the open window. Prefix sums of the turns' token counts choose
the spans: a window takes turns while the sum stays within the budget; the
next one starts with the system turn and the last turns that fit in
``history_tokens``, which it repeats with their loss masked. A turn longer
than the budget stands alone with the system turn, over the budget.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside roles and texts every
``<`` followed by backslashes and ``|`` gets one more backslash, so no control
string can occur in them, and reading removes it again; line breaks and
backslashes of a role are escaped as well.

Tokens are those of a rank file that the driver reads and broadcasts (about a
megabyte), so it need not lie on the executors. Runs of blanks are counted in
parts of at most ``BLANKS``: the splitter's own look-ahead fails on longer ones.

Defined cases: a null text or role is empty; a null conversation is one
conversation, so all rows without an id are; ids may be of any type that sorts; equal turn
numbers are ordered by role and text, rows that repeat are turns of their own; a
text of any length is one turn, alone in its window if it is over the budget; an
empty table gives no rows; extra columns are ignored, whatever their names.
One conversation is formatted by one task, as a stream: its time grows with the
conversation, its memory with one window and the longest turn.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .session import named
from .text import trimmed

START, END = "<|im_start|>", "<|im_end|>"
# Fixed value: the split pattern of the public byte-level vocabulary.
PIECES = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WINDOWS = "conv_id {id}, window long, text string, n_repeated long, n_turns long, n_tokens long, loss array<struct<start:long,stop:long>>"


def escape(s: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", s)


def unescape(s: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", s)


def escape_role(s: str) -> str:
    return escape(s.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(s: str) -> str:
    return re.sub(r"\\(\\|n)", lambda m: "\n" if m[1] == "n" else "\\", unescape(s))


BLANKS = 1000
LONG_BLANKS = re.compile(r"\s{%d}" % BLANKS)


def parts(text: str) -> list[str]:
    """The text cut after every BLANKS blanks in a row."""
    ends = [m.end() for m in LONG_BLANKS.finditer(text)]
    return [text[a:b] for a, b in zip([0, *ends], [*ends, len(text)]) if a < b]


def counter(ranks: bytes | None) -> Callable[[list[str]], list[int]]:
    """Token counts by the content of a tiktoken rank file, or by words and signs if there is none."""
    if ranks is None:
        return lambda texts: [len(re.findall(r"\w+|[^\w\s]", t)) for t in texts]
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
    enc = tiktoken.Encoding("ranks", pat_str=PIECES, mergeable_ranks=table, special_tokens={})
    return lambda texts: [sum(len(enc.encode_ordinary(x)) for x in parts(t)) if len(t) > BLANKS else len(enc.encode_ordinary(t)) for t in texts]


class _Open:
    """The window that is being filled, and what the next one repeats."""

    def __init__(self, conv, budget: int, history: int):
        self.conv, self.budget, self.history = conv, budget, history
        self.system: tuple | None = None
        self.recent: deque = deque()
        self.recent_sum = 0
        self.first, self.number = True, 0
        self.turns: list[tuple] = []
        self.repeated, self.total = 0, 0

    def add(self, turn: tuple) -> dict | None:
        """turn: (text, loss start, loss stop or 0, tokens, is a system turn). A window if this turn closes one."""
        done = None
        if len(self.turns) > self.repeated and self.total + turn[3] > self.budget:
            done = self.close()
            context = [self.system] if self.system else []
            context += [t for t in self.recent if t is not self.system]
            self.turns, self.total = context, sum(t[3] for t in context)
            self.repeated = len(context)
        if self.total + turn[3] > self.budget and len(self.turns) == self.repeated:
            fixed = int(bool(self.turns) and self.turns[0] is self.system)
            while len(self.turns) > fixed and self.total + turn[3] > self.budget:
                self.total -= self.turns.pop(fixed)[3]
            self.repeated = len(self.turns)
        self.turns.append(turn)
        self.total += turn[3]
        if self.first and turn[4]:
            self.system = turn
        self.first = False
        self.recent.append(turn)
        self.recent_sum += turn[3]
        while self.recent and self.recent_sum > self.history:
            self.recent_sum -= self.recent.popleft()[3]
        return done

    def close(self) -> dict:
        at, loss = 0, []
        for i, t in enumerate(self.turns):
            if i >= self.repeated and t[2]:
                loss.append({"start": at + t[1], "stop": at + t[2]})
            at += len(t[0])
        out = {"conv_id": self.conv, "window": self.number, "text": "".join(t[0] for t in self.turns), "n_repeated": self.repeated, "n_turns": len(self.turns), "n_tokens": self.total, "loss": loss}
        self.number += 1
        return out


def format_windows(turns: DataFrame, budget: int = 1024, history_tokens: int = 256, vocabulary: str | None = None, target_roles: tuple[str, ...] = ("assistant",), system_roles: tuple[str, ...] = ("system",)) -> DataFrame:
    """Windows of each conversation, in order within a partition.

    ``turns`` has conv_id, turn, role and text; vocabulary is the path of a rank file on the driver. loss holds the code point
    ranges of text that are trained on: the escaped texts of new target turns.
    """
    rows = named(turns, conv_id="conv_id", turn="turn", role="role", text="text")
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    schema = WINDOWS.format(id=rows.schema["conv_id"].dataType.simpleString())
    ranks = None
    if vocabulary is not None:
        with open(vocabulary, "rb") as f:
            ranks = turns.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, state, arrow = counter(ranks and ranks.value), None, None
        for batch in batches:
            arrow = arrow or pa.schema([("conv_id", batch.schema.field(0).type), ("window", pa.int64()), ("text", pa.string()), ("n_repeated", pa.int64()), ("n_turns", pa.int64()), ("n_tokens", pa.int64()), ("loss", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))])
            for a in range(0, batch.num_rows, 1000):
                part, done = batch.slice(a, 1000), []
                roles = [x or "" for x in part.column(2).to_pylist()]
                heads = [f"{START}{escape_role(r)}\n" for r in roles]
                bodies = [escape(x or "") for x in part.column(3).to_pylist()]
                texts = [f"{h}{b}{END}\n" for h, b in zip(heads, bodies)]
                for conv, role, head, body, text, n in zip(part.column(0).to_pylist(), roles, heads, bodies, texts, count(texts)):
                    if state is None or state.conv != conv:
                        if state is not None:
                            done.append(state.close())
                        state = _Open(conv, budget, history_tokens)
                    stop = len(head) + len(body) if role in target_roles and body else 0
                    if closed := state.add((text, len(head), stop, n, role in system_roles)):
                        done.append(closed)
                if done:
                    yield pa.RecordBatch.from_pylist(done, arrow)
        if state is not None:
            yield pa.RecordBatch.from_pylist([state.close()], arrow)

    return rows.mapInArrow(trimmed(run), schema)


def read_turns(text: str) -> Iterator[tuple[str, str]]:
    """Roles and texts of a formatted window."""
    for piece in text.split(START)[1:]:
        role, _, body = piece.removesuffix("\n").removesuffix(END).partition("\n")
        yield unescape_role(role), unescape(body)


DIGESTS = "conv_id {id}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long"


def digests(formatted: DataFrame) -> DataFrame:
    """Reads windows back: one row per conversation. The windows of one must follow each other in order, as format_windows returns them."""
    schema = DIGESTS.format(id=formatted.schema["conv_id"].dataType.simpleString())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, kind = None, None
        for batch in batches:
            done, kind = [], batch.schema.field(0).type
            for w in batch.to_pylist():
                if at is None or at["conv_id"] != w["conv_id"]:
                    if at is not None:
                        done.append(_row(at))
                    at = {"conv_id": w["conv_id"], "n": 0, "t": hashlib.sha256(), "lc": 0, "l": hashlib.sha256(), "fc": 0, "w": 0}
                for i, (role, text) in enumerate(read_turns(w["text"])):
                    if i >= w["n_repeated"]:
                        at["n"] += 1
                        at["t"].update(f"{role}\n{text}\n".encode())
                for x in w["loss"]:
                    said = unescape(w["text"][x["start"] : x["stop"]])
                    at["lc"] += len(said)
                    at["l"].update(said.encode())
                at["fc"] += len(w["text"])
                at["w"] += 1
            if done:
                yield _batch(done, kind)
        if at is not None:
            yield _batch([_row(at)], kind)

    return formatted.mapInArrow(trimmed(run), schema)


def _row(at: dict) -> dict:
    return {"conv_id": at["conv_id"], "n_turns": at["n"], "turns_sha256": at["t"].hexdigest(), "loss_chars": at["lc"], "loss_sha256": at["l"].hexdigest(), "formatted_chars": at["fc"], "n_windows": at["w"]}


def _batch(rows: list[dict], kind: pa.DataType) -> pa.RecordBatch:
    n, s = pa.int64(), pa.string()
    return pa.RecordBatch.from_pylist(rows, pa.schema([("conv_id", kind), ("n_turns", n), ("turns_sha256", s), ("loss_chars", n), ("loss_sha256", s), ("formatted_chars", n), ("n_windows", n)]))
