"""Suffix-array dedup by merging Burrows-Wheeler transforms.

A byte is removed if it lies in a string of ``width`` bytes that also starts in
a document of a smaller id. ``routing`` deals the pieces of text in which that
can happen at all to shards by anchor. Each group of documents builds the
transform of its pieces for each shard and sends that, not the text. A
shard merges the transforms of all groups by iterative interleave refinement:
the interleave says for every merged place from which transform its next row
comes. It starts as a merge of the rows, which each transform has in order, by as many first
symbols as fit into 64 bits (nine of some hundred different ones); each round refines
the classes of equal prefixes in it by the ranks of the rows as many and twice as many
symbols on (found in the list of the rows of each text, which the transforms'
last-to-first steps give): 9, 27, ... symbols, the last round as many as
are missing to ``width``. A class of one row
has its place for good and takes no part in later rounds, nor do rows whose text
ends before; a class whose rows agree in the symbols of a round stays as it is and
is not sorted; no suffix is sorted again. What is left of the rounds is which rows
share a prefix of ``width``: these are the repeated intervals, and the least
document of an interval decides on its windows. Windows and rows meet by walking
each text backwards from its end symbol.

Equal pieces, of one group or of several, are texts of their own throughout: their rows
meet in the intervals and nowhere else.

Each text has one end symbol, 0xFF, which no UTF-8 text holds. End symbols rank as
their texts are listed, so equal rows keep the order of the texts, and no suffix is
compared beyond its end. A step from an end symbol leads to no text in particular;
no row that reaches one takes part in a round.

Defined cases: as in ``substrings``, but for bytes, and a document never removes its own bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .routing import NEVER, Group, Windows, _ranges, repeated
from .session import named
from .substrings import covered
from .text import U

WIDTH, GRAM = 50, 16
END = 255
#: Symbols that are sorted at once when transforms are built.
SORT = 1 << 17


def order_of(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Stable order of small keys, and the keys in that order; bits: enough for a place."""
    packed = (key.astype(np.uint64) << U(bits)) | np.arange(len(key), dtype=np.uint64)
    packed.sort()
    return (packed & U((1 << bits) - 1)).view(np.int64), packed >> U(bits)


def heads(new: np.ndarray) -> np.ndarray:
    """For each place of a sorted list the first place of its class; new flags all classes but the first."""
    first = np.flatnonzero(np.append(True, new))
    return np.repeat(first, np.diff(np.append(first, len(new) + 1)))


def shared(new: np.ndarray) -> np.ndarray:
    """Flags of the places whose class has more than one member."""
    return ~(np.append(True, new) & np.append(new, True))


def split(rows: np.ndarray, begin: np.ndarray, rank: np.ndarray, keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Refines the classes of some rows, listed by class (begin: the place where it begins), by one or two ranks of each: lists the rows anew
    and sets their begins and ranks. Only classes whose members differ are sorted: which places of the list those are, and flags of classes that are still shared.

    A rank is the place where a class begins, so classes of one member keep theirs for good.
    """
    head = np.append(True, begin[1:] != begin[:-1])[: len(rows)]
    differ = np.zeros(len(rows), bool)
    for key in keys:
        differ[1:] |= key[1:] != key[:-1]
    differ &= ~head
    number = np.cumsum(head, dtype=np.int32)
    mixed = np.zeros(len(rows) + 1, bool)
    mixed[number[differ]] = True
    some = np.flatnonzero(mixed[number])
    if len(some):
        own, (b, *more) = number[some], (key[some] for key in keys)
        bits, short = len(rank).bit_length(), len(some).bit_length()
        if int(own[-1]).bit_length() + bits + short <= 64:  # sorted with the place inside the key, the last rank first
            order = None
            for c in more:
                order, _ = order_of(c, short)
            key = (own.astype(np.uint64) << U(bits)) | b.astype(np.uint64)
            last, key = order_of(key if order is None else key[order], short)
            order = last if order is None else order[last]
            new = key[1:] != key[:-1]
        else:
            order = np.lexsort((*more, b, own))
            b = b[order]
            new = (own[1:] != own[:-1]) | (b[1:] != b[:-1])
        for c in more:
            c = c[order]
            new |= c[1:] != c[:-1]
        moved = rows[some][order]
        place = begin[some]
        place += heads(new) - heads(own[1:] != own[:-1])
        rank[moved], rows[some], begin[some] = place, moved, place
        head[some[1:]] = new
    return some, shared(head[1:]) if len(rows) else head


def packed(sym: np.ndarray, bits: int) -> tuple[np.ndarray, int, int]:
    """Symbols as digits in their order (from 1), the base, and how many digits fit into so many bits."""
    used = np.bincount(sym, minlength=256) > 0
    base, fit = int(used.sum()) + 1, 1
    while base ** (fit + 1) <= 1 << bits:
        fit += 1
    return np.cumsum(used).astype(np.uint64)[sym], base, fit


def leading(code: np.ndarray, base: int, n: int) -> np.ndarray:
    """The number that the digit of each place makes with those of the n - 1 places behind it; behind the last place there are zeros."""

    def joined(x: np.ndarray, y: np.ndarray, nx: int, ny: int) -> np.ndarray:
        out = x * U(base**ny)
        out[: max(0, len(x) - nx)] += y[nx:]
        return out

    part, size, key, done = code, 1, None, 0
    while size <= n:
        if n & size:
            key, done = (part, size) if key is None else (joined(part, key, size, done), done + size)
        if 2 * size <= n:
            part = joined(part, part, size, size)
        size *= 2
    return key


def suffixes(sym: np.ndarray, end: np.ndarray, size: np.ndarray, shard: np.ndarray) -> np.ndarray:
    """All places of texts (each with END at its end) in the order of shards (from 0, rising) and suffixes; end symbols rank as their texts are listed."""
    n = len(sym)
    bits = n.bit_length()
    # as many symbols as fit beside the shard and the place; then twice as many each round, for those that still share a class
    code, base, h = packed(sym, 64 - bits - int(shard[-1]).bit_length())
    key = leading(code, base, h)
    for j in range(h):  # nothing counts behind the end symbol
        near = end[size > j] - j
        key[near] -= key[near] % U(base ** (h - 1 - j))
    key += np.repeat(shard.astype(np.uint64) * U(base**h), size)
    order, key = order_of(key, bits)
    low = key % U(base)
    low = (low == 0) | (low == U(base - 1))
    new = (key[1:] != key[:-1]) | low[1:]  # those that reach their end symbol are told apart by it
    begin = heads(new).astype(np.int32 if bits < 31 else np.int64)
    rank = np.empty(n, begin.dtype)
    rank[order] = begin
    at = np.flatnonzero(shared(new))
    rows, begin = order[at], begin[at]
    while len(rows):
        some, still = split(rows, begin, rank, [rank[rows + h]])
        order[at[some]] = rows[some]
        at, rows, begin = at[still], rows[still], begin[still]
        h *= 2
    return order


def transform(units: np.ndarray, size: np.ndarray, shard: np.ndarray) -> np.ndarray:
    """The transforms of texts, one per shard, one after the other."""
    length = size + 1
    begin = np.cumsum(length) - length
    end = begin + size
    inner = np.ones(int(length.sum()), bool)
    inner[end] = False
    sym = np.full(len(inner), END, np.uint8)
    sym[inner] = units
    before = np.empty(len(sym), np.uint8)
    before[1:] = sym[:-1]
    before[begin] = END
    return before[suffixes(sym, end, length, np.cumsum(np.append(0, shard[1:] != shard[:-1])))]


def steps(last: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of transforms one after the other (block: from 0, rising): first symbols, row of the next symbol and row of the symbol before, by row."""
    n = len(last)
    if block[-1] < 1 << 8:  # keys of 16 bits and less are sorted by radix
        following = np.argsort((block.astype(np.uint16) << 8) | last, kind="stable")
    else:
        following = np.argsort(last, kind="stable")
        owner = block[following]
        following = following[np.argsort(owner.astype(np.uint16) if block[-1] < 1 << 16 else owner, kind="stable")]
    first, following = last[following], following.astype(np.int32)
    back = np.empty(n, np.int32)
    back[following] = np.arange(n, dtype=np.int32)
    return first, following, back


def paths(first: np.ndarray, back: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The rows of every text from its first symbol to its end symbol, text after text; walked from the end symbols backwards, all texts abreast."""
    out = np.empty(len(first), np.int32)
    order = np.argsort(-size, kind="stable")
    row, at, falling = np.flatnonzero(first == END)[order], (np.cumsum(size + 1) - 1)[order], -size[order]
    out[at] = row
    live = int(np.searchsorted(falling, 0, "left"))  # texts by falling length: those with symbols left come first
    step = 0
    while live:
        row, at = back[row[:live]], at[:live] - 1
        step += 1
        out[at] = row
        live = int(np.searchsorted(falling[:live], -step, "left"))
    return out


def walk(first: np.ndarray, back: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text and place in the text of every row."""
    rows = paths(first, back, size)
    text, at = np.empty(len(first), np.int32), np.empty(len(first), np.int32)
    text[rows] = np.repeat(np.arange(len(size)), size + 1)
    at[rows] = _ranges(np.zeros(len(size), np.int64), size + 1)
    return text, at


def listed(following: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """The rows of every text as ``paths`` has them, by steps forward from the rows to which no step of their text leads."""
    out, starts = np.empty(len(reach), np.int32), np.ones(len(reach), bool)
    starts[following[reach > 0]] = False
    row = np.flatnonzero(starts)
    at = np.cumsum(reach[row] + 1) - reach[row] - 1
    while len(row):
        out[at] = row
        more = reach[row] > 0
        row, at = following[row[more]], at[more] + 1
    return out


class Merged:
    """The interleave of several transforms, as far as it tells equal prefixes of ``width`` symbols apart.

    rows: those of every text, text after text; the row some symbols on is found there. at_rank: place in the interleave where the class of a
    row begins, as rows are listed there. reach: how many symbols a row has before its end symbol; rows with fewer than a round looks at
    need no place in it.
    """

    def __init__(self, first: np.ndarray, following: np.ndarray | None, reach: np.ndarray, width: int, rows: np.ndarray | None = None):
        self.rows = listed(following, reach) if rows is None else rows
        n = len(self.rows)
        at = np.empty(n, np.intp)
        at[self.rows] = np.arange(n)
        self.reach = reach[self.rows]
        code, base, fit = packed(first[self.rows], 64)
        self.known = min(fit, width)
        # the interleave by the first symbols: a merge of rows that each transform has in order; how rows of one class are listed does not matter
        at = at[reach >= self.known]
        key = leading(code, base, self.known)[at]
        order = np.argsort(key, kind="stable")
        key, self.places = key[order], at[order]
        new = key[1:] != key[:-1]
        self.begin = (heads(new) if len(at) else at).astype(np.int32 if n.bit_length() < 31 else np.int64)
        self.at_rank = np.zeros(n, self.begin.dtype)
        self.at_rank[self.places] = self.begin
        still = shared(new) if len(at) else at.astype(bool)
        while self.known < width:
            still = self.refine(min(3 * self.known, width), still)

    def refine(self, width: int, still: np.ndarray) -> np.ndarray:
        """From classes of ``known`` symbols to those of up to three times as many: by the ranks of the rows ``known`` on and of those whose ``known`` symbols end there.
        still: flags of the rows that share a class; returned for the next round."""
        some = np.flatnonzero(still & (self.reach >= width)[self.places])
        self.places, self.begin = self.places[some], self.begin[some]
        on = [width - self.known] if width <= 2 * self.known else [self.known, width - self.known]
        _, still = split(self.places, self.begin, self.at_rank, [self.at_rank[self.places + x] for x in on])
        self.known = width
        return still

    @property
    def rank(self) -> np.ndarray:
        """The ranks by row."""
        out = np.empty(len(self.rows), self.at_rank.dtype)
        out[self.rows] = self.at_rank
        return out


class Transforms:
    """Transforms of the groups' segments, merged by shard."""

    def __init__(self, width: int):
        self.width = width

    def lengths(self, n: np.ndarray) -> np.ndarray:
        return n + self.width

    def encode(self, units: np.ndarray, off: np.ndarray, shard: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size, bodies = np.diff(off), []
        edge = np.append(np.flatnonzero(np.append(True, shard[1:] != shard[:-1])), len(shard))
        a = 0
        while a < len(edge) - 1:  # whole shards, about SORT symbols at a time
            b = max(a + 1, int(np.searchsorted(off[edge], off[edge[a]] + SORT, "right")) - 1)
            lo, hi = edge[a], edge[b]
            bodies.append(transform(units[off[lo] : off[hi]], size[lo:hi], shard[lo:hi]))
            a = b
        return np.arange(len(size)), np.concatenate(bodies)

    def decide(self, body: np.ndarray, n: np.ndarray, block: np.ndarray, doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = self.lengths(n)
        first, _, back = steps(body, np.repeat(block, size))
        rows = paths(first, back, size - 1)
        reach = np.empty(len(first), np.int32)
        reach[rows] = np.repeat((np.cumsum(size) - 1).astype(np.int32), size) - np.arange(len(first), dtype=np.int32)
        merged = Merged(first, None, reach, self.width, rows)
        # the windows: rows with width symbols of their text ahead
        rank = merged.at_rank[_ranges(np.cumsum(size) - size, n)]
        interval = np.full(len(first), NEVER)
        np.minimum.at(interval, rank, np.repeat(doc, n))
        best = interval[rank]
        return best, np.zeros(len(best), np.int64)


def removal(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    w = Windows("byte", width, gram, own=False)
    docs = named(docs, doc_id=id_col, text=text_col)

    def finish(group: Group, spans: np.ndarray) -> pa.Table:
        removed, runs, digest = [], [], []
        for first, _, h, off in group.parts():
            rows = len(off) - 1
            buf = group.buf[group.off[first] : group.off[first + rows]]
            gone = covered(spans, off, first, first + rows, width, len(h))
            text = buf[~gone].tobytes()
            at = np.concatenate([[0], np.cumsum(~gone)])[off]
            digest += [hashlib.sha256(text[a:b]).hexdigest() for a, b in zip(at[:-1], at[1:])]
            begins = gone.copy()
            begins[1:] &= ~gone[:-1]
            full = off[:-1][off[1:] > off[:-1]]
            begins[full] = gone[full]
            c = np.concatenate([[0], np.cumsum(begins)])
            removed.append(np.diff(off) - np.diff(at))
            runs.append(c[off[1:]] - c[off[:-1]])
        count = lambda x: pa.array(np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int64))
        return pa.Table.from_arrays([group.table["doc_id"], pa.array(np.diff(group.off)), count(removed), count(runs), pa.array(digest, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return repeated(docs, w, Transforms(width), finish, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string", "doc_id", "text")
