"""Substring dedup by suffix automata of reference shards.

A word is removed if it lies in a window of ``width`` words whose sequence also
starts earlier (in a document of a smaller id, or earlier in the same one).
The corpus is its own reference, so the automata of its shards are together as
large as the corpus; broadcasting all of them to every task would cost shards
times corpus. So ``routing`` deals the pieces of text in which a window can
repeat at all to the shard that owns their anchor, and only the documents that
hold something of a shard are streamed through its automaton. A shard inserts
every piece it got, copies included, in order of place into one suffix automaton
whose states keep the least place of their strings (passed up the suffix links),
then streams the pieces through it: wherever the matching statistic reaches
``width``, the state of the last ``width`` words tells where they occurred first,
and that alone decides. Of an anchor with thousands of occurrences each group of
documents has automata of its own first. A shard is some 256 KB of text and an anchor
with more occurrences is cut, so an automaton is of bounded size.

Words are told apart by 48 bits of their hash, in windows of 20 of one shard.

Defined cases: a null text has no words; a null id sorts before all; rows of one id
count as one document, so equal places do not remove each other and repeated
rows get equal results; texts shorter than a window are kept; a text of any
length is read in overlapping parts of a million words; ids may be of any type that
sorts; columns may have any names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .routing import Group, Windows, pack6, repeated, unpack6
from .session import named, plain

WIDTH, GRAM = 20, 8


def automaton(words: list[int], off: list[int]) -> tuple[list[dict], list[int], list[int], list[int]]:
    """Transitions, suffix links and lengths of the suffix automaton of several texts, and the state of each prefix."""
    nxt: list[dict] = [{}]
    link, length, state = [-1], [0], []
    for t in range(len(off) - 1):
        last = 0
        for i in range(off[t], off[t + 1]):
            c = words[i]
            q = nxt[last].get(c)
            if q is not None and length[q] == length[last] + 1:
                last = q
                state.append(last)
                continue
            if q is None:
                cur = len(nxt)
                nxt.append({})
                length.append(length[last] + 1)
                link.append(0)
                state.append(cur)
                p = last
                while p >= 0 and c not in nxt[p]:
                    nxt[p][c] = cur
                    p = link[p]
                last = cur
                if p < 0:
                    continue
                q = nxt[p][c]
                if length[q] == length[p] + 1:
                    link[cur] = q
                    continue
            else:
                cur, p = -1, last
            copy = len(nxt)
            nxt.append(nxt[q].copy())
            length.append(length[p] + 1)
            link.append(link[q])
            while p >= 0 and nxt[p].get(c) == q:
                nxt[p][c] = copy
                p = link[p]
            link[q] = copy
            if cur >= 0:
                link[cur] = copy
            else:
                last = copy
                state.append(last)
    return nxt, link, length, state


def least_ends(link: list[int], length: list[int], state: list[int], rank: list[int], width: int) -> list[int]:
    """By state: the least rank of an end of its strings, for states that hold strings of ``width`` words."""
    low = [len(rank)] * len(link)
    for s, r in zip(state, rank):
        if r < low[s]:
            low[s] = r
    # longer strings first; a state's ends are its own and those of the states that link to it
    size, up = np.array(length), np.array(link)
    inner = np.flatnonzero((size > width) & (size[up] >= width))
    for s in inner[np.argsort(-size[inner], kind="stable")].tolist():
        p = link[s]
        if low[s] < low[p]:
            low[p] = low[s]
    return low


def first_ends(words: list[int], off: list[int], width: int, rank: list[int] | None = None) -> list[int]:
    """For each window of each text, in order: the least rank (by default the place) of the end of an equal window."""
    nxt, link, length, state = automaton(words, off)
    first = least_ends(link, length, state, list(range(len(words))) if rank is None else rank, width)
    out = []
    for t in range(len(off) - 1):
        v = size = 0
        for i in range(off[t], off[t + 1]):
            c = words[i]
            while v and c not in nxt[v]:
                v = link[v]
                size = length[v]
            v = nxt[v].get(c, 0)
            size = size + 1 if v else 0
            if size >= width:  # the state of exactly the last width words
                while length[link[v]] >= width:
                    v = link[v]
                    size = length[v]
                out.append(first[v])
    return out


class Automata:
    """One automaton per shard, over the words of all its segments."""

    def __init__(self, width: int):
        self.width = width

    def lengths(self, n: np.ndarray) -> np.ndarray:
        return 6 * (n + self.width - 1)

    def encode(self, units: np.ndarray, off: np.ndarray, shard: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.arange(len(shard)), np.frombuffer(pack6(units), np.uint8)

    def decide(self, body: np.ndarray, n: np.ndarray, block: np.ndarray, doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        units, words = unpack6(body.tobytes()), n + self.width - 1
        off = np.cumsum(words) - words
        order = np.lexsort((start, doc))
        size = words[order]
        moved = np.concatenate([[0], np.cumsum(size)])
        # places of all words; pieces of one id may overlap, where its rows differ
        at_doc, at_start = np.repeat(doc[order], size), np.repeat(start[order] - moved[:-1], size) + np.arange(moved[-1])
        by = np.lexsort((at_start, at_doc))
        rank = np.empty(len(by), np.int64)
        rank[by] = np.arange(len(by))
        ends = by[first_ends(units[np.repeat(off[order] - moved[:-1], size) + np.arange(moved[-1])].tolist(), moved.tolist(), self.width, rank.tolist())]
        best_doc, best_start = at_doc[ends], at_start[ends] - self.width + 1
        # back to the given order of segments
        count = n[order]
        at = np.empty(len(order), np.int64)
        at[order] = np.cumsum(count) - count
        index = np.repeat(at - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return best_doc[index], best_start[index]


def covered(spans: np.ndarray, row_off: np.ndarray, lo: int, hi: int, width: int, n: int) -> np.ndarray:
    """Flags of the units of rows lo to hi that lie in a removed window."""
    mine = spans[(spans["row"] >= lo) & (spans["row"] < hi)]
    begin = row_off[mine["row"] - lo] + mine["start"]
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, begin, 1)
    np.add.at(edge, begin + mine["n"] + (width - 1), -1)
    return np.cumsum(edge[:-1]) > 0


def removal(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: doc_id, n_words, n_removed, kept_sha256 (kept words joined by one space)."""
    w = Windows("word", width, gram, own=True)
    docs = named(docs, doc_id=id_col, text=text_col)

    def finish(group: Group, spans: np.ndarray) -> pa.Table:
        words, removed, digest = [], [], []
        for first, s, _, off in group.parts():
            gone = covered(spans, off, first, first + s.n, width, len(s.start))
            keep = np.flatnonzero(~gone)
            more = np.zeros(len(keep), bool)  # another kept word of the row follows
            more[:-1] = s.doc[keep[1:]] == s.doc[keep[:-1]]
            mark = np.zeros(len(s.buf) + 1, np.int8)
            np.add.at(mark, s.start[keep], 1)
            np.add.at(mark, s.end[keep] + more, -1)
            mask = np.cumsum(mark[:-1], dtype=np.int8) > 0
            text = np.where(s.is_word, s.buf, 32).astype(np.uint8)[mask].tobytes()
            at = np.concatenate([[0], np.cumsum(mask)])[s.off]
            digest += [hashlib.sha256(text[a:b]).hexdigest() for a, b in zip(at[:-1], at[1:])]
            words.append(s.words)
            removed.append(np.bincount(s.doc[gone], minlength=s.n))
        count = lambda x: pa.array(np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int64))
        return pa.Table.from_arrays([group.table["doc_id"], count(words), count(removed), pa.array(digest, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return repeated(docs, w, Automata(width), finish, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_removed long, kept_sha256 string", "doc_id", "text")


def clean(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the removed words, and the space after each, cut from the text; rows left without a word go."""
    w = Windows("word", width, gram, own=True)
    names = docs.columns
    docs = plain(docs)
    fresh = docs.columns
    text_col, id_col = (f"c{names.index(c)}" for c in (text_col, id_col))

    def finish(group: Group, spans: np.ndarray) -> pa.Table:
        texts, left = [], []
        for first, s, _, off in group.parts():
            gone = covered(spans, off, first, first + s.n, width, len(s.start))
            last = np.append(s.doc[1:] != s.doc[:-1], True)[: len(s.start)]
            stop = np.where(last, s.off[s.doc + 1], np.append(s.start[1:], 0)[: len(s.start)])
            mark = np.zeros(len(s.buf) + 1, np.int8)
            np.add.at(mark, s.start[gone], 1)
            np.add.at(mark, stop[gone], -1)
            mask = np.cumsum(mark[:-1], dtype=np.int8) <= 0
            text = s.buf[mask].tobytes()
            at = np.concatenate([[0], np.cumsum(mask)])[s.off]
            texts += [text[a:b].decode() for a, b in zip(at[:-1], at[1:])]
            removed = np.bincount(s.doc[gone], minlength=s.n)
            left.append((removed == 0) | (removed < s.words))
        table = group.table.select(fresh)
        column = pa.array(texts, table.schema.field(text_col).type, mask=np.array(table[text_col].is_null().to_pylist(), bool) if texts else None)
        table = table.set_column(fresh.index(text_col), table.schema.field(text_col), column)
        return table.filter(pa.array(np.concatenate([np.zeros(0, bool), *left])))

    return repeated(docs, w, Automata(width), finish, docs.schema, id_col, text_col).toDF(*names)
