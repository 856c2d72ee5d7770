"""N-gram Jaccard join by chosen paths.

A text is its set of shingles of ``width`` words (a shorter text is one
shingle). Texts of equal sets are one node, told apart by a 63-bit key of two
independent sums over the set. The join finds all pairs of nodes
whose sets have a Jaccard similarity of ``threshold`` or more, in steps:

1. every set gets ``COORDS`` minhash values; two sets agree on a coordinate with
   a probability that is their similarity;
2. chosen paths: at the root of each of ``RUNS`` runs, and at every node of the
   tree below it, a random few coordinates (1 / threshold of them on average)
   are chosen, and the sets split by their values there; a bucket of at most
   ``SMALL`` sets stops, larger ones split again, at most ``LEVELS`` times;
3. buckets are brute-forced on the minhash values, with a margin for their
   error; only spanning stars of the clumps of what may be similar leave a task;
4. the components of those stars are cut into blocks of at most ``EXACT`` sets,
   sets of equal first minhash together, and a pair of blocks is compared,
   set by set and exactly, only if sets of both were in one clump. Links are
   counted where they are found, not listed; a spanning forest of the exact
   links gives the classes.

A pair at the threshold survives to depth 1 / 2 / 4 of one run with probability 0.63
/ 0.47 / 0.31 (``survival``); the number of runs follows from the target recall,
as if all buckets had to split to the last level. More similar pairs, and those in
small buckets, are found more often.

No task gets more than a bounded number of sets: buckets that the paths cannot
split (near copies by the thousand) and large components are cut into blocks, and
each pair of blocks is a task of its own. Where all texts of a large group are
similar, each link is verified and the work grows with the square of the distinct
texts; where similarity only chains, with the pairs of blocks that meet. Rows do not grow.

Defined cases: a null or blank text has no set and is its own class; rows of
equal sets are linked, whatever their ids; a null id ranks before all others;
ids may be of any type that sorts; a text of any length is one set, cut into
words at once; an empty table gives no rows; columns may have any names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components, written
from .session import named, plain, ranked
from .text import Slice, U, cut, mix, trimmed, windows, within

WIDTH, THRESHOLD = 5, 0.8
#: Of pairs at the threshold, in buckets that split to the last level.
RECALL = 0.985
COORDS, LEVELS, SMALL, BLOCK = 64, 4, 128, 1024
#: Buckets above SMALL (16 bytes each) are broadcast up to this many; beyond, they are joined.
LARGE_PATHS = 200_000
#: Sets, and shingles, of one block of an exact comparison.
EXACT, BLOCK_SHINGLES = 512, 400_000
STRIP = 256
_rng = np.random.default_rng(977)
_XOR = _rng.integers(0, 1 << 32, COORDS, dtype=np.uint64).astype(np.uint32)
_MUL = _rng.integers(0, 1 << 32, COORDS, dtype=np.uint64).astype(np.uint32) | np.uint32(1)


def shingles(s: Slice, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles, row by row in order of first place, and their offsets."""
    wh = s.word_hashes()
    ok = np.flatnonzero(within(s.doc, width))
    h, row = windows(wh, width)[ok], s.doc[ok]
    short = np.flatnonzero((s.words > 0) & (s.words < width))
    if len(short):
        whole = np.array([int(mix(np.array([np.bitwise_xor.reduce(mix(wh[a:b] + np.arange(b - a, dtype=np.uint64))) + U(b - a)], np.uint64))[0]) for a, b in zip(s.word_off[short], s.word_off[short + 1])], np.uint64)
        h, row = np.concatenate([h, whole]), np.concatenate([row, short])
        order = np.argsort(row, kind="stable")
        h, row = h[order], row[order]
    own = mix(h + row.astype(np.uint64) * U(0xA24BAED4963EE407))
    order = np.argsort(own, kind="stable")
    first = np.zeros(len(h), bool)
    first[order] = np.append(True, own[order][1:] != own[order][:-1])[: len(h)]
    h, row = h[first], row[first]
    return h, np.searchsorted(row, np.arange(s.n + 1))


def set_keys(h: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One 63-bit key per set, equal for equal sets; empty sets get -1."""
    out = np.full(len(off) - 1, -1, np.int64)
    full = np.flatnonzero(np.diff(off))
    if len(full):
        at = off[full]
        total = np.add.reduceat(mix(h), at) + mix(np.add.reduceat(mix(h ^ U(0x2545F4914F6CDD1D)), at) + np.diff(off)[full].astype(np.uint64))
        out[full] = (mix(total) >> U(1)).astype(np.int64)
    return out


def minhashes(h: np.ndarray, off: np.ndarray) -> np.ndarray:
    """COORDS values for each set that is not empty."""
    full = off[:-1][np.diff(off) > 0]
    h = (h >> U(32)).astype(np.uint32)
    out = np.empty((COORDS, len(full)), np.uint32)
    for t in range(COORDS if len(full) else 0):
        v = h ^ _XOR[t]
        v ^= v >> np.uint32(15)
        v *= _MUL[t]
        out[t] = np.minimum.reduceat(v, full)
    return np.ascontiguousarray(out.T)


def survival(levels: int) -> float:
    """Probability that a pair at the threshold shares a path of this depth: one child each on average, a Poisson number of them."""
    q = 1.0
    for _ in range(levels):
        q = 1 - math.exp(-q)
    return q


def runs_for(recall: float, levels: int = LEVELS) -> int:
    """Independent runs that find a pair at the threshold with the given probability."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - survival(levels))))


def children(paths: np.ndarray, sketch: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """For rows at nodes of the tree: row and child of each chosen coordinate."""
    coord = np.arange(COORDS, dtype=np.uint64) * U(0xD1B54A32D192ED03)
    odds = U(min(int(2.0**64 / (threshold * COORDS)), 2**64 - 1))
    row, at = np.nonzero(mix(paths[:, None] + coord[None, :]) < odds)
    child = mix(mix(paths[row] ^ (coord[at] + U(0x632BE59BD9B4E019))) + sketch[row, at].astype(np.uint64))
    return row, child


def _forest(near: np.ndarray) -> np.ndarray:
    """Least index of the component of each index, of a symmetric matrix of links."""
    label = np.arange(len(near), dtype=np.int32)
    np.fill_diagonal(near, True)
    while True:
        strips = (near[i : i + STRIP] for i in range(0, len(near), STRIP))
        new = np.concatenate([np.where(x, label[None, :], np.int32(len(near))).min(axis=1) for x in strips])
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def _grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Consecutive rows that agree on the first ``keys`` columns, whole."""
    rest: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        t = t if rest is None else pa.concat_tables([rest, t])
        rest = None
        new = np.zeros(t.num_rows, bool)
        for c in range(keys):
            x = t.column(c).to_numpy()
            new[1:] |= x[1:] != x[:-1]
        cuts = np.append(0, np.flatnonzero(new))
        for a, b in zip(cuts[:-1], cuts[1:]):
            yield t.slice(a, b - a)
        rest = t.slice(cuts[-1]).combine_chunks()
    if rest is not None and rest.num_rows:
        yield rest


def candidates(nodes: DataFrame, threshold: float, runs: int, levels: int) -> DataFrame:
    """Stars (u, v, clump) of what may be similar in a bucket: v is the least of its clump. nodes: (k, sketch)."""

    def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 2048):
                part = batch.slice(a, 2048)
                sketch = np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint32).reshape(-1, COORDS)
                row, child = children(part.column(0).to_numpy().view(np.uint64), sketch, threshold)
                yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), part.column(1).take(pa.array(row))], ["path", "k"])

    roots = [F.lit(int(x)) for x in mix(np.arange(1, runs + 1, dtype=np.uint64)).view(np.int64)]
    at = nodes.select(F.explode(F.array(*roots)).alias("path"), "k", "sketch")
    small = None
    for level in range(1, levels + 1):
        rows = written(at.mapInArrow(trimmed(descend), "path long, k long"))
        sizes = written(rows.groupBy("path").agg(F.count("*").alias("n")).where("n > 1"))
        over = sizes.where(F.col("n") > SMALL)
        # rows of large buckets leave before the others are joined by bucket: no join key holds many rows
        over = F.broadcast(over) if over.limit(LARGE_PATHS + 1).count() <= LARGE_PATHS else over
        large = written(rows.join(over, "path"))
        done = written(rows.join(over.select("path"), "path", "left_anti").join(sizes.hint("merge"), "path"))
        small = done if small is None else small.unionByName(done)
        if level == levels:
            small = small.unionByName(large)
        elif not large.limit(1).count():
            break
        at = large.join(nodes.hint("merge"), "k").select("path", "k", "sketch")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    units = small.withColumn("of", blocks).withColumn("b", F.pmod(F.xxhash64("k"), F.col("of")).cast("int"))
    units = units.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("of") - 1)))
    units = units.select("path", F.least("b", "j").alias("x"), F.greatest("b", "j").alias("y"), "k").join(nodes.select("k", "sketch").hint("merge"), "k").select("path", "x", "y", "k", "sketch")
    margin = int(COORDS * threshold - 3 * np.sqrt(COORDS * threshold * (1 - threshold)))

    def brute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[np.ndarray] = []
        for g in _grouped(batches, 3):
            n = g.num_rows
            if n > 1:
                k = g.column(3).to_numpy()
                sketch = np.frombuffer(b"".join(g.column(4).to_pylist()), np.uint32).reshape(n, COORDS)
                same = np.zeros((n, n), np.uint8)
                for t in range(COORDS):
                    same += sketch[:, t, None] == sketch[None, :, t]
                label = _forest(same >= margin)
                moved = np.flatnonzero(label != np.arange(n))
                if len(moved):
                    here = np.array([g.column(c)[0].as_py() for c in range(3)], np.int64).view(np.uint64)
                    clump = mix(mix(here[:1] + mix(here[1:2] << U(32) | here[2:])) + label[moved].astype(np.uint64))
                    found.append(np.stack([k[moved], k[label[moved]], clump.view(np.int64)]))
            if sum(x.shape[1] for x in found) > 50_000:
                yield _stars(found)
                found = []
        if found:
            yield _stars(found)

    dealt = units.repartition("path", "x", "y").sortWithinPartitions("path", "x", "y")
    return dealt.mapInArrow(trimmed(brute), "u long, v long, clump long")


def _stars(found: list[np.ndarray]) -> pa.RecordBatch:
    e = np.concatenate(found, axis=1)
    return pa.RecordBatch.from_arrays([pa.array(x) for x in e], ["u", "v", "clump"])


def overlap(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections of sets of hashes."""
    n = len(sets)
    who = np.repeat(np.arange(n), [len(x) for x in sets])
    every = np.concatenate(sets)
    order = np.argsort(every, kind="stable")
    v, who = every[order], who[order]
    new = np.append(True, v[1:] != v[:-1])
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1
    who, column = who[shared], column[shared]
    out = np.zeros((n, n), np.float32)
    if not len(column):
        return out
    column = np.cumsum(np.append(0, column[1:] != column[:-1]))
    step = 2048
    edges = np.searchsorted(column, np.arange(0, column[-1] + 1 + step, step))
    for a, b in zip(edges[:-1], edges[1:]):
        if b > a:
            lo = column[a]
            dense = np.zeros((n, int(column[b - 1] - lo) + 1), np.float32)
            dense[who[a:b], column[a:b] - lo] = 1
            out += dense @ dense.T
    return out


def links(docs: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD, recall: float = RECALL, levels: int = LEVELS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: doc_id, class_id, n_links, n_shingles.

    class_id is the least id of the texts connected by links; n_links counts the
    other rows with a set of the given similarity, copies included.
    """
    out = _linked(named(docs, doc_id=id_col, text=text_col), width, threshold, runs_for(recall, levels), levels)
    own = F.when(F.col("first").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id"))
    return out.select("doc_id", own.alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.col("n_shingles").cast("long").alias("n_shingles"))


def _linked(docs: DataFrame, width: int, threshold: float, runs: int, levels: int) -> DataFrame:
    """The rows (doc_id, text) with id (rank), t (hash of the text), n_shingles, first (least id, t, doc_id of the class) and n_links (both null: no set)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = ranked(docs, "doc_id", "id").select("doc_id", "id", "text", F.xxhash64("text").alias("t"))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, s in cut(batch.column(2)):
                h, off = shingles(s, width)
                data = minhashes(h, off)
                at = np.cumsum(np.diff(off) > 0) - 1
                full = np.diff(off) > 0
                cells = [data[i].tobytes() if f else None for i, f in zip(at, full)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in (0, 1, 3)), pa.array(set_keys(h, off)), pa.array(np.diff(off)), pa.array(cells, pa.binary())], ["doc_id", "id", "t", "k", "n", "sketch"])

    rows = written(docs.mapInArrow(trimmed(sketch), f"doc_id {kind}, id long, t long, k long, n long, sketch binary"))
    nodes = written(rows.where("k >= 0").groupBy("k").agg(F.min(F.struct("id", "t", "doc_id")).alias("first"), F.count("*").alias("members"), F.first("n").alias("n"), F.first("sketch").alias("sketch")))
    stars = written(candidates(nodes.select("k", "sketch"), threshold, runs, levels))
    exact = written(_verify(docs, nodes, stars, width, threshold))
    classes = components(exact.where("v IS NOT NULL").select("u", "v"))
    count = exact.groupBy("u").agg(F.sum("links").alias("links")).withColumnRenamed("u", "k")
    with_label = nodes.join(classes.withColumnRenamed("node", "k").hint("merge"), "k", "left").select("k", "members", F.coalesce("label", "k").alias("label"), "first")
    least = with_label.groupBy("label").agg(F.min("first").alias("least"))
    by_node = with_label.join(least.hint("merge"), "label").join(count.hint("merge"), "k", "left").select("k", F.col("least").alias("first"), (F.col("members") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    return rows.select("doc_id", "id", "t", "k", F.col("n").alias("n_shingles")).join(by_node.hint("merge"), "k", "left")


def _blocks(nodes: DataFrame, stars: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(k, members, first, block) of the sets of loose components, and the pairs of blocks (x <= y) to compare."""
    loose = components(stars.select("u", "v"))
    member = nodes.select("k", "members", "n", "first", F.substring("sketch", 1, 4).alias("c0")).join(loose.withColumnRenamed("node", "k").hint("merge"), "k")
    parts = F.greatest(F.ceil(F.col("c") / EXACT), F.ceil(F.col("s") / BLOCK_SHINGLES)).cast("int")
    size = member.groupBy("label").agg(F.count("*").alias("c"), F.sum("n").alias("s")).select("label", parts.alias("of"))
    # a large component: cells of equal first minhash, and those that are too large cut again
    member = member.join(size.hint("merge"), "label").withColumn("cell", F.pmod(F.xxhash64("c0"), F.col("of")).cast("int"))
    size = member.groupBy("label", "cell").agg(F.count("*").alias("c"), F.sum("n").alias("s")).select("label", "cell", parts.alias("parts"))
    member = member.join(size.hint("merge"), ["label", "cell"]).withColumn("block", F.xxhash64("label", "cell", F.pmod(F.xxhash64("k"), F.col("parts"))))
    member = written(member.withColumn("whole", (F.col("of") == 1) & (F.col("parts") == 1)).select("k", "members", "first", "block", "whole"))
    cut_up = member.where("NOT whole").select("k", "block")
    met = stars.select("clump", F.col("u").alias("k")).unionByName(stars.select("clump", F.col("v").alias("k")).distinct()).join(cut_up.hint("merge"), "k").select("clump", "block").distinct()
    met = written(met)
    pairs = met.withColumnRenamed("block", "x").join(met.withColumnRenamed("block", "y").hint("merge"), "clump").where("x < y").select("x", "y").distinct()
    own = member.select(F.col("block").alias("x"), F.col("block").alias("y")).distinct()
    return member, own.unionByName(pairs)


def _verify(docs: DataFrame, nodes: DataFrame, stars: DataFrame, width: int, threshold: float) -> DataFrame:
    """(u, v, links): for each set its links per task, and an edge of the task's exact spanning forest or null."""
    member, pairs = _blocks(nodes, stars)
    texts = docs.select("id", "t", "text").join(member.select(F.col("first.id").alias("id"), F.col("first.t").alias("t"), "k", "members", "block").hint("merge"), ["id", "t"]).select("text", "k", "members", "block")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, s in cut(batch.column(0)):
                h, off = shingles(s, width)
                part = batch.slice(a, b - a)
                ok = np.flatnonzero(set_keys(h, off) == part.column(1).to_numpy())
                cells = pa.array([np.sort(h[off[i] : off[i + 1]]).tobytes() for i in ok], pa.binary())
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(pa.array(ok)) for c in (3, 1, 2)), cells], ["block", "k", "members", "set"])

    ready = texts.mapInArrow(trimmed(sets), "block long, k long, members long, set binary")
    ends = pairs.select(F.col("x").alias("block"), "x", "y").unionByName(pairs.where("x < y").select(F.col("y").alias("block"), "x", "y"))
    units = ready.join(ends.hint("merge"), "block").select("x", "y", "block", "k", "members", "set")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u, v, n = [], [], []
        for g in _grouped(batches, 2):
            k, at = np.unique(g.column(3).to_numpy(), return_index=True)
            if len(k) > 1:
                block = g.column(2).to_numpy()[at]
                members = g.column(4).to_numpy()[at]
                cells = g.column(5).to_pylist()
                own = [np.frombuffer(cells[i], np.uint64) for i in at]
                both = overlap(own)
                size = np.array([len(x) for x in own], np.float64)
                near = np.empty(both.shape, bool)
                for i in range(0, len(k), STRIP):
                    part = both[i : i + STRIP].astype(np.float64)
                    near[i : i + STRIP] = part >= threshold * (size[i : i + STRIP, None] + size[None, :] - part) - 1e-9
                np.fill_diagonal(near, False)
                if g.column(0)[0].as_py() != g.column(1)[0].as_py():
                    near &= block[:, None] != block[None, :]  # pairs within a block have a task of their own
                some = np.flatnonzero(near.any(axis=1))
                label = _forest(near.copy())
                u.append(k[some])
                v.append(k[label[some]])
                n.append((near[some] @ members).astype(np.int64))
            if sum(map(len, u)) > 50_000:
                yield _counted(u, v, n)
                u, v, n = [], [], []
        if u:
            yield _counted(u, v, n)

    return units.repartition("x", "y").sortWithinPartitions("x", "y").mapInArrow(trimmed(compare), "u long, v long, links long")


def _counted(u: list, v: list, n: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (u, v, n)], ["u", "v", "links"])


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, threshold: float = THRESHOLD, recall: float = RECALL, levels: int = LEVELS) -> DataFrame:
    """``docs`` with one row of each class, that of the least id; of rows of one id in a class, any one text.

    Rows are told apart by id and text, so ids may repeat or be null; repeated rows and rows without a set stay once.
    """
    rows = plain(docs)
    own, text = (f"c{docs.columns.index(c)}" for c in (id_col, text_col))
    found = _linked(rows.select(F.col(own).alias("doc_id"), F.col(text).alias("text")), width, threshold, runs_for(recall, levels), levels)
    gone = found.where("first IS NOT NULL AND (id <> first.id OR t <> first.t)").select(F.col("doc_id").alias("g_id"), F.col("t").alias("g_t")).distinct()
    kept = rows.join(gone, rows[own].eqNullSafe(F.col("g_id")) & (F.xxhash64(rows[text]) == F.col("g_t")), "left_anti")
    return kept.dropDuplicates([own, text]).toDF(*docs.columns)
