"""Repeated windows at scale: which shard looks at which piece of which text.

A text is a sequence of units (words or bytes); a window is ``width``
consecutive units of one text. Every window has one anchor, the smallest
hash of the ``gram`` consecutive units in it (the leftmost, if equal), so
equal windows have equal anchors, and windows can be dealt to shards by
anchor. Consecutive windows with the same anchor form a run, one short
segment of text. The plan:

1. ask: each group of documents names its anchors, each once with its count;
2. count: a bucket of shards sums them and tells each group which of its anchors
   occur twice or more anywhere (in two documents, where windows of one document
   do not count); all other windows are unique and go no further;
3. send: each group sends the segments of those anchors, encoded by the method,
   every occurrence with its place;
4. decide: for each shard the method finds the least place of every window in
   the segments that arrived, and the windows that occur earlier return as ranges
   of starts;
5. finish: each group takes its own ranges and reads off the result.

Hashes only deal segments out. No segment stands for another: each occurrence is
read by the method, and whether a window goes is what ``Method.decide`` says of it.

Groups are dealt by a hash of the row and hold about ``GROUP_BYTES`` of text, so
no key of the data decides their size; there are as many tasks as groups, and as
many as buckets. A bucket holds the shards of about ``BUCKET_BYTES`` of text and
is one row per group that has something for it, so rows are at most groups times
buckets, and never more than segments. An anchor with ``HOT`` occurrences or more
is decided in two steps: each group runs the method over its own segments of it
first, in parts of the size of a shard, and sends only the windows that are the
first in their part, one by one, dealt by a hash of their content. So a passage in a third of all documents
reaches its shards once per group. Documents cross the network once (Spark reuses
that exchange); nothing is gathered on the driver but a sum. All steps are
deterministic, so lost executors are replaced by recomputation.

Ids may be of any type that sorts; those that are not integers are replaced by
their rank first (a sort and a join by id). Columns may have any names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import ranked, shuffle_partitions
from .text import BYTE_HASH, Slice, Sums, U, flat, hold, release, slices

GROUP_BYTES = 8 << 20
BUCKET_BYTES = 16 << 20
#: Text for one shard, by unit; its segments are up to 1 + width / run as much.
SHARD_BYTES = {"word": 1 << 18, "byte": 1 << 16}
HOT = 4096
PIECE = 1 << 17
POS = 21
#: A run is at most width - gram + 1 windows: with one anchor they all hold it.
TEXT = np.dtype([("shard", "<u2"), ("n", "<u2")])
PLACE = np.dtype([("doc", "<i8"), ("row", "<u4"), ("start", "<u4")])
SPAN = np.dtype([("row", "<u4"), ("start", "<u4"), ("n", "<u4")])
NEVER = (1 << 63) - 1


@dataclass(frozen=True)
class Windows:
    """What repeats: width units, anchors of gram units; unit is "word" or "byte".

    own: whether an earlier window of the same document counts as well.
    """

    unit: str
    width: int
    gram: int
    own: bool


class Method(Protocol):
    """How equal windows are found among the segments of a shard. A segment of n windows takes lengths(n) bytes."""

    def lengths(self, n: np.ndarray) -> np.ndarray: ...

    def encode(self, units: np.ndarray, off: np.ndarray, shard: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The segments of one group, by shard (rising): their order within their shards, and their bytes in that order."""

    def decide(self, body: np.ndarray, n: np.ndarray, block: np.ndarray, doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least (doc, start) of every window of every segment of a shard; NEVER where the method does not find the window.

        Segments come by group (block, rising), as each was encoded, with their windows (n) and places (doc, start).
        """


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n consecutive values, by doubling."""
    parts, size, at = {1: h}, 1, h
    while 2 * size <= n:
        at = mix1(at[:-size] * U(0x9FB21C651E98DF25) + at[size:])
        size *= 2
        parts[size] = at
    out, done = parts[size], size
    while done < n:
        size = max(p for p in parts if p <= n - done)
        out = mix1(out[: len(h) - done - size + 1] * U(0xD1B54A32D192ED03) + parts[size][done : len(h) - size + 1])
        done += size
    return out


def mix1(h: np.ndarray) -> np.ndarray:
    h ^= h >> U(32)
    h *= U(0x9E3779B97F4A7C15)
    h ^= h >> U(29)
    return h


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    size = 1
    while 2 * size <= n:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (n - size)], x[n - size :]) if n > size else x


def runs(h: np.ndarray, doc: np.ndarray, w: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths (in windows) and anchors of the runs over some units."""
    m = len(h) - w.width + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    g = grams(h, w.gram)
    g >>= U(POS)
    g <<= U(POS)
    g |= np.arange(len(g), dtype=np.uint64)
    low = sliding_min(g, w.width - w.gram + 1)
    valid = doc[:m] == doc[w.width - 1 :]
    new = np.ones(m, bool)
    new[1:] = (low[1:] != low[:-1]) | ~valid[:-1]
    stops = np.append(np.flatnonzero(new | ~valid), m)
    start = np.flatnonzero(new & valid)
    end = stops[np.searchsorted(stops, start, "right")]
    return start, end - start, low[start] >> U(POS)


def pieces(off: np.ndarray, w: Windows) -> Iterator[tuple[int, int, int, int]]:
    """(first row, row after the last, first unit, unit after the last); a long row comes in overlapping parts."""
    for a, b in slices(off, PIECE):
        if b - a > 1 or off[b] - off[a] <= PIECE:
            yield a, b, off[a], off[b]
        else:
            for at in range(off[a], max(off[a] + 1, off[b] - w.width + 1), PIECE):
                yield a, b, at, min(at + PIECE + w.width - 1, off[b])


class Group:
    """The documents of a group, in order of id and content."""

    def __init__(self, table: pa.Table, text_col: str, w: Windows):
        ids, keys = table["r_id"].to_numpy(), table["r_key"].to_numpy()
        self.order = np.lexsort((keys, ids))
        self.table = table.take(pa.array(self.order))
        self.w, self.ids = w, ids[self.order]
        self.text = self.table[text_col]
        self.buf, self.off = flat(self.text)

    def parts(self) -> Iterator[tuple[int, Slice | None, np.ndarray, np.ndarray]]:
        """(first row, words, unit hashes, unit offsets of the rows) of parts of about 1 MB."""
        for a, b in slices(self.off):
            buf, off = self.buf[self.off[a] : self.off[b]], self.off[a : b + 1] - self.off[a]
            if self.w.unit == "byte":
                yield a, None, BYTE_HASH[buf], off
            else:
                s = Slice(buf, off)
                yield a, s, s.word_hashes(), s.word_off

    def runs(self) -> Iterator[tuple]:
        """By piece: unit hashes, row, start in the row, start in the piece, start in all units, length, anchor."""
        base = 0
        for first, _, h, off in self.parts():
            for a, b, x, y in pieces(off, self.w):
                part = h[x:y]
                doc = np.repeat(np.arange(a, b), np.minimum(off[a + 1 : b + 1], y) - np.maximum(off[a:b], x))
                start, n, key = runs(part, doc, self.w)
                row = doc[start]
                yield part, first + row, start + x - off[row], start, start + x + base, n, key
            base += int(off[-1])

    def units(self) -> np.ndarray:
        """All units, as runs() numbers them."""
        if self.w.unit == "byte":
            return self.buf
        return np.concatenate([np.zeros(0, np.uint64), *(h for _, _, h, _ in self.parts())])


def pack6(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def unpack6(b: bytes) -> np.ndarray:
    x = np.frombuffer(b, np.uint8).reshape(-1, 6)
    out = np.zeros((len(x), 8), np.uint8)
    out[:, :6] = x
    return out.reshape(-1).view("<u8")


def planes(x: np.ndarray) -> bytes:
    """Fixed-size items byte by byte: all first bytes, all second ones, so that equal high bytes pack away in the shuffle."""
    return np.ascontiguousarray(np.frombuffer(x.tobytes(), np.uint8).reshape(-1, x.dtype.itemsize).T).tobytes()


def unplane(b: bytes, dtype: np.dtype) -> np.ndarray:
    return np.frombuffer(np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(dtype.itemsize, -1).T).tobytes(), dtype)


def pack_sorted(x: np.ndarray) -> bytes:
    """Rising numbers as their steps."""
    step = x.astype(np.uint64)
    step[1:] -= x[:-1].astype(np.uint64)
    return planes(step.astype("<u8"))


def unpack_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(unplane(b, np.dtype("<u8")), dtype=np.uint64)


def anchors(keys: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different anchors of a group in their order, how often each occurs, and whether all of these are in one document."""
    order = np.argsort(keys, kind="stable")
    keys, doc = keys[order], doc[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    if not len(first):
        return keys, first, first.astype(bool)
    return keys[first], np.diff(np.append(first, len(keys))), np.maximum.reduceat(doc, first) == np.minimum.reduceat(doc, first)


def _by_shard(shard: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    shard = shard.astype(np.uint16) if n <= 1 << 16 else shard  # sorted by radix
    order = np.argsort(shard, kind="stable")
    cuts = np.append(0, np.cumsum(np.bincount(shard, minlength=n)))
    for s in np.flatnonzero(np.diff(cuts)):
        yield int(s), order[cuts[s] : cuts[s + 1]]


Finish = Callable[[Group, np.ndarray], pa.Table]


def repeated(docs: DataFrame, w: Windows, method: Method, finish: Finish, schema: str, id_col: str, text_col: str, hot: int | None = None) -> DataFrame:
    """Runs the plan. docs has plain column names; finish turns a group and its removed ranges (SPAN, in units) into rows of ``schema``."""
    most = HOT if hot is None else hot
    spark = docs.sparkSession
    total = docs.agg(F.coalesce(F.sum(F.octet_length(docs[text_col])), F.lit(0)).alias("b")).first()["b"]
    n_groups = max(shuffle_partitions(spark), -(-total // GROUP_BYTES))
    n_buckets = max(shuffle_partitions(spark), -(-total // BUCKET_BYTES))
    per_bucket = min(-(-total // (n_buckets * SHARD_BYTES[w.unit])) or 1, 1 << 15)
    n_shards = n_buckets * per_bucket
    rk = F.xxhash64(docs[id_col], docs[text_col])
    dealt = ranked(docs, id_col, "r_id").withColumns({"r_key": rk, "r_g": F.pmod(rk, F.lit(n_groups)).cast("int")}).repartition(n_groups, "r_g")

    def ask(table: pa.Table) -> pa.Table:
        hold()
        g, keys, rows = table["r_g"][0].as_py(), [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        group = Group(table, text_col, w)
        for _, row, *_, key in group.runs():
            keys.append(key)
            rows.append(row)
        keys, count, single = anchors(np.concatenate(keys), group.ids[np.concatenate(rows)])
        bucket = (keys % U(n_shards)).astype(np.int64) // per_bucket
        out = [(s, g, pack_sorted(keys[i]), planes(count[i].astype("<u4")), single[i].tobytes()) for s, i in _by_shard(bucket, n_buckets)]
        return _table(out, ["r_s", "r_g", "keys", "counts", "single"])

    def count(table: pa.Table) -> pa.Table:
        keys = [unpack_sorted(x) for x in table["keys"].to_pylist()]
        if not keys:
            return _table([], ["r_g", "keys"])
        every = np.concatenate(keys)
        counts = np.concatenate([unplane(x, np.dtype("<u4")) for x in table["counts"].to_pylist()])
        _, at = np.unique(every, return_inverse=True)
        total = np.bincount(at, weights=counts)[at]
        if w.own:
            shared = total >= 2
        else:  # several documents of one group, or documents of several groups
            shared = np.bincount(at, weights=2 - np.frombuffer(b"".join(table["single"].to_pylist()), bool))[at] >= 2
        coded = (every << U(1)) | (total >= most)
        ends = np.cumsum([len(k) for k in keys])
        out = [(g, pack_sorted(coded[b - len(k) : b][shared[b - len(k) : b]])) for g, k, b in zip(table["r_g"].to_pylist(), keys, ends)]
        return _table([x for x in out if x[1]], ["r_g", "keys"])

    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["r_s", "r_g", "texts", "places", "body", "spans"]
        if not left.num_rows or not right.num_rows:
            return _table([], names)
        hold()
        g = left["r_g"][0].as_py()
        coded = np.sort(np.concatenate([unpack_sorted(x) for x in right["keys"].to_pylist()]))
        known, is_hot = coded >> U(1), (coded & U(1)).astype(bool)
        group, found = Group(left, text_col, w), []
        for part, row, start, local, place, n, key in group.runs():
            at = np.minimum(np.searchsorted(known, key), len(known) - 1)
            ok = np.flatnonzero(known[at] == key)
            if len(ok):
                local, n, hot_ok = local[ok], n[ok], is_hot[at[ok]]
                each = _ranges(local[hot_ok], n[hot_ok])  # windows of frequent anchors
                hashed = Sums(part).hashes(each, each + w.width) if len(each) else np.zeros(0, np.uint64)
                found.append((row[ok], start[ok], place[ok], n, key[ok], hot_ok, hashed))
        if not found:
            return _table([], names)
        row, start, place, n, key, hot_run, window = (np.concatenate([x[k] for x in found]) for k in range(7))
        del found
        units, spans, shard = group.units(), np.zeros(0, SPAN), (key % U(n_shards)).astype(np.int64)
        if hot_run.any():
            h, gone, runs_, steps_ = np.flatnonzero(hot_run), [], [], []
            for part in _batches(row, start, n, key, h, group.ids, w, method):
                span, run, step = _first(units, row, start, place, n, part, group.ids, w, method)
                gone.append(span)
                runs_.append(run)
                steps_.append(step)
            spans, run, step = merge_spans(np.concatenate(gone)), np.concatenate(runs_), np.concatenate(steps_)
            base = np.zeros(len(row), np.int64)
            base[h] = np.cumsum(n[h]) - n[h]
            first = window[base[run] + step]
            keep = np.flatnonzero(~hot_run)
            row, start, place = (np.concatenate([x[keep], x[run] + y]) for x, y in ((row, 0), (start, step), (place, step)))
            n, shard = np.concatenate([n[keep], np.ones(len(run), np.int64)]), np.concatenate([shard[keep], ((first >> U(POS)) % U(n_shards)).astype(np.int64)])
        order, body = _encoded(row, start, place, n, shard, group.ids, units, w, method)
        text, m = np.zeros(len(order), TEXT), np.zeros(len(order), PLACE)
        shard, m["doc"], m["row"], m["start"] = shard[order], group.ids[row[order]], row[order], start[order]
        bucket = shard // per_bucket
        text["shard"], text["n"] = shard - bucket * per_bucket, n[order]
        out = [(g % n_buckets, g, b"", b"", b"", spans.tobytes())] if len(spans) else []
        load = np.append(0, np.cumsum(method.lengths(n[order])))
        cut = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(text))
        for a, b in zip(cut[:-1], cut[1:]):
            out.append((int(bucket[a]), g, planes(text[a:b]), planes(m[a:b]), body[load[a] : load[b]].tobytes(), b""))
        return _table(out, names)

    def judge(table: pa.Table) -> pa.Table:
        hold()
        out, rows = [], []
        for g, texts, places, body, spans in zip(*(table[c].to_pylist() for c in ("r_g", "texts", "places", "body", "spans"))):
            if spans:
                out.append((g, spans))
            if texts:
                rows.append((g, unplane(texts, TEXT), unplane(places, PLACE), body))
        rows.sort(key=lambda x: x[0])  # one order, however the rows arrived
        if rows:
            out += [(g, s.tobytes()) for g, s in _verdicts(rows, w, method)]
        return _table(out, ["r_g", "spans"])

    def done(left: pa.Table, right: pa.Table) -> pa.Table:
        hold()
        group = Group(left, text_col, w)
        spans = np.frombuffer(b"".join(right["spans"].to_pylist()), SPAN) if right.num_rows else np.zeros(0, SPAN)
        out = finish(group, spans)
        release()
        return out

    asked = dealt.groupBy("r_g").applyInArrow(ask, "r_s int, r_g int, keys binary, counts binary, single binary").repartition(n_buckets, "r_s")
    replies = asked.groupBy("r_s").applyInArrow(count, "r_g int, keys binary").repartition(n_groups, "r_g")
    sent = dealt.groupBy("r_g").cogroup(replies.groupBy("r_g")).applyInArrow(send, "r_s int, r_g int, texts binary, places binary, body binary, spans binary").repartition(n_buckets, "r_s")
    verdicts = sent.groupBy("r_s").applyInArrow(judge, "r_g int, spans binary").repartition(n_groups, "r_g")
    return dealt.groupBy("r_g").cogroup(verdicts.groupBy("r_g")).applyInArrow(done, schema)


def _table(rows: list[tuple], names: list[str]) -> pa.Table:
    release()  # a group is done
    kinds = [pa.int32() if n in ("r_s", "r_g") else pa.binary() for n in names]
    columns = zip(*rows) if rows else [[] for _ in names]
    return pa.Table.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names)


def _ranges(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... (n of them), for each."""
    return np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def _encoded(row: np.ndarray, start: np.ndarray, place: np.ndarray, n: np.ndarray, shard: np.ndarray, ids: np.ndarray, units: np.ndarray, w: Windows, method: Method) -> tuple[np.ndarray, np.ndarray]:
    """Order of the segments of a group by shard, as the method lists them, and their bytes."""
    order = np.lexsort((start, ids[row], shard))
    size = n[order] + w.width - 1
    listed, body = method.encode(units[_ranges(place[order], size)], np.append(0, np.cumsum(size)), shard[order])
    return order[listed], body


def _batches(row: np.ndarray, start: np.ndarray, n: np.ndarray, key: np.ndarray, some: np.ndarray, ids: np.ndarray, w: Windows, method: Method) -> Iterator[np.ndarray]:
    """Some runs, anchor by anchor and in order of place, in parts of about the size of a shard."""
    some = some[np.lexsort((start[some], ids[row[some]], key[some]))]
    load = np.cumsum(method.lengths(n[some])) // SHARD_BYTES[w.unit]
    cuts = np.append(np.flatnonzero(np.append(True, load[1:] != load[:-1])), len(some))
    for a, b in zip(cuts[:-1], cuts[1:]):
        yield some[a:b]


def _gone(best_doc: np.ndarray, best_start: np.ndarray, doc: np.ndarray, start: np.ndarray, own: bool) -> np.ndarray:
    gone = best_doc < doc
    return gone | ((best_doc == doc) & (best_start < start)) if own else gone


def _first(units: np.ndarray, row: np.ndarray, start: np.ndarray, place: np.ndarray, n: np.ndarray, part: np.ndarray, ids: np.ndarray, w: Windows, method: Method) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The method over some runs (part) of one group: windows that occur earlier in it (SPAN), and (run, step) of the first ones."""
    row, start, place, n = row[part], start[part], place[part], n[part]
    order, body = _encoded(row, start, place, n, np.zeros(len(part), np.int64), ids, units, w, method)
    n, doc = n[order], ids[row[order]]
    best_doc, best_start = method.decide(body, n, np.zeros(len(order), np.int64), doc, start[order])
    each, step = np.repeat(order, n), _ranges(np.zeros(len(order), np.int64), n)
    gone = _gone(best_doc, best_start, np.repeat(doc, n), start[each] + step, w.own)
    spans = np.zeros(int(gone.sum()), SPAN)
    spans["row"], spans["start"], spans["n"] = row[each[gone]], start[each[gone]] + step[gone], 1
    return spans, part[each[~gone]], step[~gone]


def merge_spans(spans: np.ndarray) -> np.ndarray:
    """Joins ranges of starts that touch."""
    if not len(spans):
        return spans
    s = spans[np.lexsort((spans["start"], spans["row"]))]
    end = s["start"].astype(np.int64) + s["n"]
    new = np.ones(len(s), bool)
    new[1:] = (s["row"][1:] != s["row"][:-1]) | (s["start"][1:] > end[:-1])
    at = np.flatnonzero(new)
    out = s[at].copy()
    out["n"] = np.maximum.reduceat(end, at) - out["start"]
    return out


def _verdicts(rows: list[tuple[int, np.ndarray, np.ndarray, bytes]], w: Windows, method: Method) -> Iterator[tuple[int, np.ndarray]]:
    """rows: group, segments, places and body. Shard by shard, the windows of each group that occur earlier."""
    text, m = np.concatenate([r[1] for r in rows]), np.concatenate([r[2] for r in rows])
    source = np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows])
    body = np.frombuffer(b"".join(r[3] for r in rows), np.uint8)
    n = text["n"].astype(np.int64)
    size = method.lengths(n)
    begin = np.cumsum(size) - size
    order = np.argsort(text["shard"], kind="stable")
    shard = text["shard"][order]
    cuts = np.append(np.flatnonzero(np.append(True, shard[1:] != shard[:-1])), len(shard))
    # the bytes of a shard, stretch by stretch of what a group sent for it
    stretch = np.flatnonzero(np.append(True, (shard[1:] != shard[:-1]) | (order[1:] != order[:-1] + 1)))
    lo, hi = begin[order[stretch]], (begin + size)[order[np.append(stretch[1:], len(order)) - 1]]
    near = np.searchsorted(stretch, cuts)
    found = []
    for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
        t = order[a:b]
        mine = m[t]
        own = np.concatenate([body[x:y] for x, y in zip(lo[near[k] : near[k + 1]].tolist(), hi[near[k] : near[k + 1]].tolist())])
        begins = mine["start"].astype(np.int64)
        best_doc, best_start = method.decide(own, n[t], source[t], mine["doc"], begins)
        each = np.repeat(np.arange(len(t)), n[t])
        start = _ranges(begins, n[t])
        gone = np.flatnonzero(_gone(best_doc, best_start, mine["doc"][each], start, w.own))
        each, start = each[gone], start[gone]
        run = np.flatnonzero(np.append(True, (each[1:] != each[:-1]) | (start[1:] != start[:-1] + 1))) if len(gone) else gone
        spans = np.zeros(len(run), np.dtype([("source", "<u4"), ("row", "<u4"), ("start", "<u4"), ("n", "<u4")]))
        spans["source"], spans["row"], spans["start"] = source[t][each[run]], mine["row"][each[run]], start[run]
        spans["n"] = np.diff(np.append(run, len(gone)))
        found.append(spans)
    spans = np.concatenate(found)
    spans = spans[np.argsort(spans["source"], kind="stable")]
    cuts = np.searchsorted(spans["source"], np.arange(len(rows) + 1))
    for k in np.flatnonzero(np.diff(cuts)):
        x = spans[cuts[k] : cuts[k + 1]]
        one = np.zeros(len(x), SPAN)
        for f in ("row", "start", "n"):
            one[f] = x[f]
        yield rows[k][0], merge_spans(one)
