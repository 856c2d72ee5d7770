"""Quality rules by repetition coverage.

For several n-gram lengths, rolling 64-bit hashes over the words of a text
find the n-grams that occur at least twice in it; the rule measures the share
of the text's word characters inside their second and later occurrences, and
the share inside lines that repeat an earlier line. Everything is vectorised over slices of about 2 MB;
no row depends on another, so there is no shuffle and no skew.

Defined cases: a null or blank text has no words, all counts are 0 and it
fails the base rule; rows that repeat are judged alike, each on its own; a share equal to its
limit is kept; ids may be null or of any type; a text of any length is one slice; an empty table
gives no rows; extra columns, whatever their names, are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .session import named, plain
from .text import Slice, U, cut, mix, trimmed, windows, within

#: Largest share of word characters inside n-grams that occurred before in the text.
MAX_COVERAGE: Mapping[int, float] = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
#: Largest share of lines, and of word characters, in lines that repeat an earlier one.
MAX_DUP_LINES, MAX_DUP_LINE_CHARS = 0.30, 0.20
_SYMBOL = np.zeros(256, bool)
_SYMBOL[np.frombuffer(b"#*$%&|<>", np.uint8)] = True


def _repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flags of keys that occur twice or more, and of those that occurred before."""
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    same = s[1:] == s[:-1]
    twice, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order[1:][same]] = True
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return twice, later


def _own(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    return mix(h + doc.astype(np.uint64) * U(0xA24BAED4963EE407))


def measure(s: Slice, coverage: Mapping[int, float] = MAX_COVERAGE, dup_lines: float = MAX_DUP_LINES, dup_line_chars: float = MAX_DUP_LINE_CHARS, min_words: int = 10, max_symbols: float | None = None) -> dict[str, np.ndarray]:
    """The columns of the rule, one value per row of the slice."""
    lead = (s.buf & 0xC0) != 0x80
    in_word = np.concatenate([[0], np.cumsum(lead & s.is_word, dtype=np.int64)])
    chars = in_word[s.off[1:]] - in_word[s.off[:-1]]
    out = {"n_words": s.words.astype(np.int64), "word_chars": chars, "n_symbols": s.per_row(_SYMBOL[s.buf])}
    # lines
    cuts = np.flatnonzero(s.buf == 10)
    begin = np.unique(np.concatenate([s.off[:-1][s.off[1:] > s.off[:-1]], cuts + 1]))
    begin = begin[begin < len(s.buf)]
    line_doc = np.searchsorted(s.off, begin, "right") - 1
    stop = np.minimum(np.append(begin[1:], len(s.buf)), s.off[line_doc + 1]) if len(begin) else begin
    ends_nl = (s.buf[stop - 1] == 10) if len(begin) else np.zeros(0, bool)
    stop = stop - ends_nl
    has = in_word[stop] > in_word[begin]
    begin, stop, line_doc = begin[has], stop[has], line_doc[has]
    _, again = _repeats(_own(s.hashes(begin, stop), line_doc))
    n_lines = np.bincount(line_doc, minlength=s.n)
    out["n_dup_lines"] = np.bincount(line_doc[again], minlength=s.n).astype(np.int64)
    line_chars = np.bincount(line_doc[again], weights=(in_word[stop] - in_word[begin])[again], minlength=s.n)
    # n-grams
    wh, word_chars = s.word_hashes(), in_word[s.end] - in_word[s.start]
    bad = (out["n_dup_lines"] > dup_lines * n_lines) | (line_chars > dup_line_chars * chars)

    def inside(n: int) -> tuple[np.ndarray, np.ndarray]:
        """Flags of words in n-grams that occur twice or more, and in those that occurred before."""
        ok = np.flatnonzero(within(s.doc, n))
        both = []
        for flag in _repeats(_own(windows(wh, n)[ok], s.doc[ok])):
            edge = np.zeros(len(wh) + 1, np.int32)
            np.add.at(edge, ok[flag], 1)
            np.add.at(edge, ok[flag] + n, -1)
            both.append(np.cumsum(edge[:-1]) > 0)
        return both[0], both[1]

    at5 = inside(5)
    out["n_repeat_words"] = np.bincount(s.doc[at5[0]], minlength=s.n).astype(np.int64)
    for n, most in coverage.items():
        covered = (at5 if n == 5 else inside(n))[1]
        bad |= np.bincount(s.doc[covered], weights=word_chars[covered], minlength=s.n) > most * chars
    if max_symbols is not None:
        bad |= out["n_symbols"] > max_symbols * np.maximum(out["n_words"], 1)
    out["base_failed"] = (out["n_words"] < min_words) | (100 * out["n_repeat_words"] > 20 * out["n_words"])
    out["kept"] = ~out["base_failed"] & ~bad
    return out


OUT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits) -> DataFrame:
    """One row per row of ``docs``: its id and the columns of OUT."""
    docs = named(docs, doc_id=id_col, text=text_col)
    names = [x.split()[0] for x in OUT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for a, b, s in cut(batch.column(1)):
                m = measure(s, **limits)
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), *(pa.array(m[x]) for x in names)], ["doc_id", *names])

    return docs.mapInArrow(trimmed(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {OUT}")


def keep(docs: DataFrame, text_col: str = "text", **limits) -> DataFrame:
    """The rows of ``docs`` that pass, all columns unchanged."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [measure(s, **limits)["kept"] for _, _, s in cut(batch.column(at))]
            if kept:
                yield batch.filter(pa.array(np.concatenate(kept)))

    rows = plain(docs)
    return rows.mapInArrow(trimmed(run), rows.schema).toDF(*docs.columns)
