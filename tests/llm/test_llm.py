"""The training-data operators against brute force, on small tables that hold the awkward cases."""

from __future__ import annotations

import hashlib
import random
import re
import textwrap
import zlib
from collections import Counter
from importlib import resources

import numpy as np
import pytest
from pyspark.sql import functions as F

from clausewright.llm import chat, decontaminate, jaccard, licenses, mixing, quality, queries, repetition, routing, session, substrings, suffixarrays, urls
from clausewright.llm.text import Slice, cut, windows

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(seed=3, n=60):
    """Random texts with shared passages, exact and near copies, nulls, empties, periodic and long texts."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdeéß", k=rng.randint(1, 7))) for _ in range(300)]
    passage = " ".join(rng.choices(vocabulary, k=45))
    rows = []
    for i in range(n):
        words = rng.choices(vocabulary, k=rng.choice([0, 1, 4, 12, 60, 200]))
        if i % 4 == 0:
            words[len(words) // 2 : len(words) // 2] = passage.split()
        if i % 9 == 5 and len(rows) > 3:
            words = (rows[-3][1] or "").split()
            if len(words) > 30 and i % 2:
                words[7] = "changed"
        rows.append((i, rng.choice([" ", "\n", "  \t"]).join(words)))
    rows += [(100, None), (101, ""), (102, "a b " * 60), (103, " \n\t"), (104, "x" * 300), (105, "y" * 49), (106, rows[0][1]), (106, rows[0][1]), (None, rows[4][1]), (107, " ".join(rng.choices(vocabulary, k=5000)))]
    return [(i, t, "en", rng.choice(["a", "b", None]), len(t or "")) for i, t in rows]


@pytest.fixture(scope="module")
def docs(spark):
    rows = documents()
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def order(i):
    return -(1 << 63) if i is None else i


# -- 1 n-gram Jaccard join


def shingle_set(text):
    w = WORDS.findall(text or "")
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def classes(rows, threshold=0.8):
    sets = [shingle_set(r[1]) for r in rows]
    parent, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]) - 1e-9:
                links[i] += 1
                links[j] += 1
                parent[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, r in enumerate(rows):
        least[find(i)] = min(least.get(find(i), 1 << 62), order(r[0]))
    return sorted(((order(r[0]), least[find(i)], links[i]) for i, r in enumerate(rows)))


def test_jaccard(spark, docs):
    rows, df = docs
    got = sorted((order(r["doc_id"]), order(r["class_id"]), r["n_links"]) for r in jaccard.links(df).collect())
    assert got == classes(rows)
    assert jaccard.links(empty(spark)).count() == 0


def test_jaccard_large_groups(spark, monkeypatch):
    """Near copies in more blocks than one, and buckets that paths cannot split."""
    rng = random.Random(1)
    base = [str(rng.random()) for _ in range(120)]
    rows = []
    for i in range(40):
        w = list(base)
        w[i % 60] = f"n{i}"
        rows.append((i, " ".join(w), "en", "a", 0))
    for name, value in (("SMALL", 8), ("BLOCK", 16), ("EXACT", 9), ("BLOCK_SHINGLES", 3000)):
        monkeypatch.setattr(jaccard, name, value)  # all read on the driver
    clash = {"id": F.lit(1), "k": F.lit("clash"), "_gone": F.lit(2), "t": F.lit(3), "c0": F.lit(4), "a.b": F.lit(5)}
    df = spark.createDataFrame(rows, SCHEMA).withColumns(clash)
    got = sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in jaccard.links(df).collect())
    assert got == classes(rows)
    monkeypatch.setattr(jaccard, "LARGE_PATHS", 0)
    kept = jaccard.representatives(df)
    assert kept.columns == df.columns and [tuple(r)[5:] for r in kept.collect()] == [(1, "clash", 2, 3, 4, 5)] and kept.first()["doc_id"] == 0


def test_forest(monkeypatch):
    """Strips of any height give the same components."""
    rng = np.random.default_rng(5)
    for n in (1, 2, 13, 60):
        near = rng.random((n, n)) < 1.2 / n
        near |= near.T
        want = jaccard._forest(near.copy()).tolist()
        monkeypatch.setattr(jaccard, "STRIP", 7)
        assert jaccard._forest(near.copy()).tolist() == want
        assert all(want[i] == want[j] for i, j in zip(*np.nonzero(near))) and all(want[x] == x <= i for i, x in enumerate(want))
        monkeypatch.undo()


def test_jaccard_chain(spark, monkeypatch):
    """A chain of texts, each like the next only, in many blocks: pairs of blocks that do not meet are not compared."""
    rng = random.Random(21)
    words = [f"{rng.random():.6f}" for _ in range(3000)]
    rows = [(i, " ".join(words[9 * i : 9 * i + 150]), "en", "a", 0) for i in range(300)]
    monkeypatch.setattr(jaccard, "EXACT", 10)
    compared = []
    blocks = jaccard._blocks
    monkeypatch.setattr(jaccard, "_blocks", lambda *x: compared.append(out := blocks(*x)) or out)
    got = sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in jaccard.links(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == classes(rows)
    member, pairs = compared[0]
    n = member.select("block").distinct().count()
    assert n >= 25 and pairs.count() < n * n / 4


def test_jaccard_recall(spark):
    """3,000 texts in buckets that must split: pairs at 0.80 to 0.85 in a crowd of common openings."""
    assert [round(jaccard.survival(k), 2) for k in (1, 2, 4)] == [0.63, 0.47, 0.31] and jaccard.runs_for(0.985) == 12 and jaccard.runs_for(0.9) == 7
    rng = random.Random(31)
    common = [f"c{k}" for k in range(60)]
    rows, pairs = [], []
    for i in range(1500):  # all texts share a third of their shingles: no bucket at the root is small
        own = [f"{rng.random():.6f}" for _ in range(90)]
        at = rng.choice([13, 14, 15, 16, 17])
        other = own[: -at] + [f"{rng.random():.6f}" for _ in range(at - 1)]
        rows += [(2 * i, " ".join(common + own), "en", "a", 0), (2 * i + 1, " ".join(common + other), "en", "a", 0)]
        sets = [shingle_set(r[1]) for r in rows[-2:]]
        j = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
        pairs.append((2 * i, j))
    near = {i for i, j in pairs if j >= 0.8}
    assert len(near) > 1000 and sum(0.8 <= j < 0.87 for _, j in pairs) > 1000
    got = {r["doc_id"]: r for r in jaccard.links(spark.createDataFrame(rows, SCHEMA)).collect()}
    found = sum(got[i]["n_links"] == 1 and got[i + 1]["class_id"] == i for i in near)
    assert found >= 0.95 * len(near), found / len(near)
    assert all(got[i]["n_links"] == got[i + 1]["n_links"] == 0 for i, j in pairs if j < 0.8)


def test_jaccard_ids(spark):
    """Ids that are no numbers, a null one, repeated rows, and a text of 400,000 words."""
    rng = random.Random(8)
    long = [f"{rng.random():.5f}" for _ in range(400_000)]
    rows = [("d2", " ".join(long)), ("d1", " ".join([*long, "more"])), ("d2", "a b c d e f"), ("d9", "a b c d e f"), (None, "x y z"), ("d3", "x y z"), ("d3", "x y z"), ("e", None), ("f", "")]
    got = sorted(((r["doc_id"] or "", r["class_id"] or "", r["n_links"]) for r in jaccard.links(spark.createDataFrame(rows, "doc_id string, text string")).collect()))
    assert got == sorted([("d2", "d1", 1), ("d1", "d1", 1), ("d2", "d2", 1), ("d9", "d2", 1), ("", "", 2), ("d3", "", 2), ("d3", "", 2), ("e", "e", 0), ("f", "f", 0)])


def test_representatives(spark):
    """One row of each class where ids repeat or are null, and no unique text lost."""
    rng = random.Random(5)
    a, b, c, d, e = (" ".join(str(rng.random()) for _ in range(80)) for _ in range(5))
    rows = [(1, a), (2, a + " more"), (2, b), (None, c), (None, c + " more"), (None, c), (3, c), (None, d), (4, e), (4, e + "\n"), (4, e), (2, None), (2, None), (None, None), (5, " "), (6, "")]
    df = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in rows], SCHEMA)
    got = Counter((r["doc_id"], r["text"]) for r in jaccard.representatives(df).collect())
    assert max(got.values()) == 1 and {k for k in got if (k[1] or " ")[:20] not in (c[:20], e[:20])} == {(1, a), (2, b), (None, d), (2, None), (None, None), (5, " "), (6, "")}
    assert [k[0] for k in got if (k[1] or "").startswith(c[:20])] == [None] and [k[0] for k in got if (k[1] or "").startswith(e[:20])] == [4]


def test_overlap():
    a, b, c = (np.array(x, np.uint64) for x in ([1, 2, 3], [2, 3, 4], [9]))
    assert jaccard.overlap([a, b, c])[:2, :2].tolist() == [[2, 2], [2, 2]] and jaccard.overlap([a, b, c])[0, 2] == 0


# -- 2 and 3 repeated windows


def removed_words(rows, width=20):
    seen, out = {}, Counter()
    for k in sorted(range(len(rows)), key=lambda k: order(rows[k][0])):
        w = WORDS.findall(rows[k][1] or "")
        for p in range(len(w) - width + 1):
            g = tuple(w[p : p + width])
            seen[g] = min(seen.get(g, (1 << 62, 0)), (order(rows[k][0]), p))
    for i, t, *_ in rows:
        w, gone = WORDS.findall(t or ""), set()
        for p in range(len(w) - width + 1):
            if seen[tuple(w[p : p + width])] < (order(i), p):
                gone.update(range(p, p + width))
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        out[(i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())] += 1
    return out


def removed_bytes(rows, width=50):
    seen, out = {}, Counter()
    for i, t, *_ in rows:
        b = (t or "").encode()
        for p in range(len(b) - width + 1):
            seen[b[p : p + width]] = min(seen.get(b[p : p + width], 1 << 62), order(i))
    for i, t, *_ in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - width + 1):
            if seen[b[p : p + width]] < order(i):
                gone[p : p + width] = b"\1" * width
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[(i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())] += 1
    return out


@pytest.mark.parametrize("hot", [4096, 3])
def test_substrings(spark, docs, monkeypatch, hot):
    """Also where anchors that occur three times are frequent: groups decide among themselves first."""
    rows, df = docs
    monkeypatch.setattr(routing, "HOT", hot)
    assert Counter(tuple(r) for r in substrings.removal(df).collect()) == removed_words(rows)
    assert Counter(tuple(r) for r in suffixarrays.removal(df).collect()) == removed_bytes(rows)


@pytest.mark.parametrize("hot", [4096, 3])
def test_substrings_many_shards(spark, docs, monkeypatch, hot):
    """Groups, buckets and shards of a few texts each."""
    rows, df = docs
    monkeypatch.setattr(routing, "HOT", hot)
    for name, value in (("GROUP_BYTES", 4096), ("BUCKET_BYTES", 8192), ("SHARD_BYTES", {"word": 512, "byte": 512})):
        monkeypatch.setattr(routing, name, value)
    assert Counter(tuple(r) for r in substrings.removal(df).collect()) == removed_words(rows)
    assert Counter(tuple(r) for r in suffixarrays.removal(df).collect()) == removed_bytes(rows)


@pytest.mark.parametrize("hot", [4096, 3])
@pytest.mark.parametrize("op", [substrings, suffixarrays])
def test_only_the_method_removes(spark, docs, monkeypatch, op, hot):
    """With a method that finds nothing, or nothing but the places it is given, nothing is removed, copies and frequent passages included."""
    _, df = docs
    monkeypatch.setattr(routing, "HOT", hot)
    known = op.Automata if op is substrings else op.Transforms

    class Blind(known):
        def decide(self, body, n, block, doc, start):
            none = np.full(int(n.sum()), (1 << 63) - 1)
            return none, none

    class Own(known):
        def decide(self, body, n, block, doc, start):
            return np.repeat(doc, n), routing._ranges(start, n)

    for blind in (Blind, Own):
        monkeypatch.setattr(op, known.__name__, blind)
        assert op.removal(df).agg(F.sum("n_removed")).first()[0] == 0


@pytest.mark.parametrize("hot", [4096, 3])
def test_substrings_repeated_ids(spark, monkeypatch, hot):
    """Rows that share an id and differ in text: a later piece of one may hold a window at an earlier place than an earlier piece of another."""
    monkeypatch.setattr(routing, "HOT", hot)
    rng = random.Random(31)
    words = [f"w{k}" for k in range(400)]
    rows = []
    for i in range(60):
        at = rng.randint(0, 300)
        for _ in range(rng.randint(1, 3)):
            lead = rng.choices(words, k=rng.randint(0, 12))
            rows.append((i if i % 7 else None, " ".join(lead + words[at + rng.randint(0, 3) : at + rng.randint(20, 70)])))
    df = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in rows], SCHEMA).repartition(5)
    assert Counter(tuple(r) for r in substrings.removal(df).collect()) == removed_words(rows)
    assert Counter(tuple(r) for r in suffixarrays.removal(df).collect()) == removed_bytes(rows)


def test_substrings_hot_in_one_group(spark):
    """An anchor with 10,000 occurrences in one group is counted whole, goes the way of frequent ones, and is cut into parts of bounded size."""
    rows = [(1, "a b " * 20_000), (2, "b a " * 300 + "c"), (3, "x" * 3_000), (4, "x" * 2_000 + "y")]
    df = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in rows], SCHEMA)
    for op, want in ((substrings, removed_words), (suffixarrays, removed_bytes)):
        assert Counter(tuple(r) for r in op.removal(df).collect()) == want(rows)
    # the same steps of a group, in this process
    w, method = routing.Windows("byte", 50, 16, False), suffixarrays.Transforms(50)
    n = np.full(40_000, 35)
    row, start = np.repeat(np.arange(4), 10_000), np.tile(np.arange(10_000) * 35, 4)
    cut = list(routing._batches(row, start, n, np.zeros(40_000, np.uint64), np.arange(40_000), np.arange(4), w, method))
    assert sorted(np.concatenate(cut).tolist()) == list(range(40_000))
    assert max(int(method.lengths(n[c]).sum()) for c in cut) <= routing.SHARD_BYTES["byte"] + 85


def test_substrings_long_texts(spark):
    """Texts of several parts of a million units: what repeats across the cuts, early in one and late in the other."""
    rng = random.Random(12)
    words = [f"{rng.random():.5f}" for _ in range(1_300_000)]
    shared = words[1_048_500:1_048_700]
    long = " ".join(words)
    rows = [(1, long), (2, "x " + " ".join(shared) + " y"), (3, " ".join(rng.choices(words, k=150_000) + words[5:60]))]
    df = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in rows], SCHEMA).repartition(2)
    assert Counter(tuple(r) for r in substrings.removal(df).collect()) == removed_words(rows)
    got = {r["doc_id"]: r for r in suffixarrays.removal(df).collect()}
    assert got[1]["n_removed"] == 0 and got[2]["n_removed"] == len(" " + " ".join(shared) + " ") and got[3]["n_removed"] >= len(" ".join(words[5:60]))


@pytest.mark.parametrize("kind", ["string", "decimal(20,2)", "date"])
def test_ids_of_other_types(spark, docs, kind):
    """Ids that are not integers: earlier is what sorts before."""
    rows, df = docs
    rows = [r for r in rows if r[0] is None or r[0] < 60]
    names = {"string": lambda i: f"d{i * 7 % 61:03}", "decimal(20,2)": lambda i: i / 4 - 3, "date": lambda i: None}
    if kind == "date":
        as_id = F.expr("date_add(DATE'2020-01-01', CAST(doc_id AS INT))")
        rank = {r[0]: r[0] for r in rows}
    else:
        told = spark.createDataFrame([(r[0], names[kind](r[0])) for r in rows if r[0] is not None], "i long, n string").select("i", F.col("n").cast(kind).alias("n"))
        rank = {i: k for k, i in enumerate(r["i"] for r in told.orderBy("n").collect())}
    df = df.where("doc_id IS NULL OR doc_id < 60")
    new = df.withColumn("doc_id", as_id) if kind == "date" else df.join(told, df["doc_id"] == told["i"], "left").select(F.col("n").alias("doc_id"), "text", "lang", "source", "n_chars")
    moved = [(None if r[0] is None else rank[r[0]], *r[1:]) for r in rows]
    digest = lambda c: sorted(k[1:] for k in c.elements())
    assert sorted(tuple(r)[1:] for r in substrings.removal(new).collect()) == digest(removed_words(moved))
    assert sorted(tuple(r)[1:] for r in suffixarrays.removal(new).collect()) == digest(removed_bytes(moved))


def test_substrings_edges(spark, docs):
    assert substrings.removal(empty(spark)).count() == 0 and suffixarrays.removal(empty(spark)).count() == 0
    rows, df = docs
    clash = df.withColumns({"r_g": F.lit(9), "_route_g": F.lit(9), "c0": F.lit("x"), "a.b": F.lit(2), "row": F.lit(3)})
    kept = substrings.clean(clash)
    assert kept.columns == clash.columns and kept.schema == clash.schema
    assert {tuple(r)[5:] for r in kept.collect()} == {(9, 9, "x", 2, 3)}
    texts = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert texts[100] is None and texts[101] == "" and 106 not in texts  # nothing is left of a whole copy
    words = Counter((k[0], k[1] - k[2]) for k in removed_words(rows).elements() if k[1] == 0 or k[1] > k[2])
    assert Counter((i, len(WORDS.findall(t or ""))) for i, t in ((r["doc_id"], r["text"]) for r in kept.collect())) == words


def test_automaton():
    rng = random.Random(2)
    for _ in range(30):
        texts = [[rng.randint(0, 2) for _ in range(rng.randint(4, 14))] for _ in range(4)]
        flat = [x for t in texts for x in t]
        off = np.cumsum([0, *map(len, texts)]).tolist()
        want = []
        for t in range(4):
            for p in range(len(texts[t]) - 2):
                g = texts[t][p : p + 3]
                want.append(min(off[u] + s + 2 for u in range(4) for s in range(len(texts[u]) - 2) if texts[u][s : s + 3] == g))
        assert substrings.first_ends(flat, off, 3) == want


def test_merged_transforms():
    """Transforms of several blocks, merged: order and classes of all rows by the width, and the least document of every window."""
    rng = random.Random(4)
    for _ in range(60):
        width = rng.choice([3, 5, 6, 9, 18])
        method = suffixarrays.Transforms(width)
        texts, bodies, block = [], [], []
        for b in range(rng.randint(1, 5)):
            own = [bytes(rng.choices(b"ab", k=rng.randint(width, width + 12))) for _ in range(rng.randint(1, 9))]
            own += rng.choices(own, k=rng.randint(0, 6))  # equal texts are texts of their own
            order, last = method.encode(np.frombuffer(b"".join(own), np.uint8), np.cumsum([0, *map(len, own)]), np.zeros(len(own), np.int64))
            texts += [own[i] for i in order]
            block += [b] * len(own)
            bodies.append(last)
        n = np.array([len(t) - width + 1 for t in texts])
        doc = np.array([rng.randint(0, 50) for _ in texts])
        rows = np.repeat(np.array(block), method.lengths(n))
        first, following, back = suffixarrays.steps(np.concatenate(bodies), rows)
        text, at = suffixarrays.walk(first, back, n + width - 1)
        reach = (n + width - 1)[text] - at
        merged = suffixarrays.Merged(first, following, reach, width)
        whole = [r for r in range(len(rows)) if reach[r] >= width]  # rows of whole windows
        heads = {r: texts[text[r]][at[r] : at[r] + width] for r in whole}
        by_rank = sorted(whole, key=lambda r: merged.rank[r])
        assert [heads[r] for r in by_rank] == sorted(heads.values())
        assert all((heads[x] == heads[y]) == (merged.rank[x] == merged.rank[y]) for x, y in zip(by_rank, by_rank[1:]))
        best, _ = method.decide(np.concatenate(bodies), n, np.array(block), doc, np.zeros(len(doc), np.int64))
        least = {}
        for t, d in zip(texts, doc):
            for p in range(len(t) - width + 1):
                least[t[p : p + width]] = min(least.get(t[p : p + width], 99), d)
        assert best.tolist() == [least[t[p : p + width]] for t in texts for p in range(len(t) - width + 1)]


def test_suffixes_end_at_their_text():
    """Suffixes by shard and symbols, and where they reach their ends by text: nothing is compared beyond an end symbol."""
    rng = random.Random(14)
    for _ in range(60):
        texts = [bytes(rng.choices(b"ab" if rng.random() < 0.7 else bytes(range(97, 123)), k=rng.randint(1, 30))) for _ in range(rng.randint(1, 12))]
        texts += rng.choices(texts, k=rng.randint(0, 6))
        shard = sorted(rng.randint(0, 2) for _ in texts)
        shard = np.cumsum(np.append(0, np.diff(shard) > 0))
        size = np.array([len(t) + 1 for t in texts])
        sym = np.frombuffer(b"".join(t + b"\xff" for t in texts), np.uint8)
        keys = [(shard[k], [*t[p:], 256 + k]) for k, t in enumerate(texts) for p in range(len(t) + 1)]
        assert suffixarrays.suffixes(sym, np.cumsum(size) - 1, size, shard).tolist() == sorted(range(len(keys)), key=keys.__getitem__)


def test_steps_of_many_blocks():
    """First symbols and steps are the same for few, some hundred and many thousand blocks."""
    rng = np.random.default_rng(3)
    for blocks in (1, 200, 300, 70_000):
        block, last = np.sort(rng.integers(0, blocks, 5_000)), rng.integers(0, 4, 5_000).astype(np.uint8)
        want = np.lexsort((np.arange(5_000), last, block))
        first, following, back = suffixarrays.steps(last, block)
        assert (following == want).all() and (first == last[want]).all() and (back[want] == np.arange(5_000)).all()


def test_copies_are_not_sorted_again(monkeypatch):
    """Rounds sort the classes whose rows differ: none where all texts are copies, few where one text ends otherwise."""
    rng = random.Random(15)
    method, done, order_of = suffixarrays.Transforms(50), [], suffixarrays.order_of
    monkeypatch.setattr(suffixarrays, "order_of", lambda key, bits: done.append(len(key)) or order_of(key, bits))
    text = bytes(rng.choices(range(33, 120), k=84))
    for other, more in ((text, 0), (text[:70] + bytes(14), 0.5)):
        texts = [text] * 49 + [other]
        order, body = zip(*(method.encode(np.frombuffer(b"".join(texts[a : a + 10]), np.uint8), np.arange(11) * 84, np.zeros(10, np.int64)) for a in range(0, 50, 10)))
        doc = np.concatenate([a * 10 + o for a, o in enumerate(order)])
        done.clear()
        best, _ = method.decide(np.concatenate(body), np.full(50, 35), np.repeat(np.arange(5), 10), doc, np.zeros(50, np.int64))
        rows = 50 * 85
        assert sum(done) <= (2 + more) * rows, sum(done) / rows  # once by the symbols before them, once by their first ones
        best = best.reshape(50, 35)[np.argsort(doc)]
        assert (best[:49] == 0).all() and (best[49] == 0).sum() == (35 if other == text else 21)


def test_repeats_of_one_document_are_not_sent(spark, monkeypatch):
    """What occurs several times in one document and in no other cannot be removed: no transform is built of it. Also anchors of a group by document."""
    rng = random.Random(16)
    text = lambda n: "".join(rng.choices("abcdefghij klmnop", k=n))
    rows = [(1, " ".join([text(300)] * 6)), (2, text(2_000)), (3, "z" * 900), (None, None)]

    class Loud(suffixarrays.Transforms):
        def encode(self, units, off, shard):
            raise AssertionError("sent")

    monkeypatch.setattr(suffixarrays, "Transforms", Loud)
    df = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in rows], SCHEMA)
    assert Counter(tuple(r) for r in suffixarrays.removal(df).collect()) == removed_bytes(rows)
    keys, count, single = routing.anchors(np.array([7, 5, 7, 5, 9, 7], np.uint64), np.array([1, 1, 1, 2, 3, 1]))
    assert keys.tolist() == [5, 7, 9] and count.tolist() == [2, 3, 1] and single.tolist() == [False, True, True]


def test_rounds_of_a_merge(monkeypatch):
    """Rows in order are merged by nine symbols, then told apart by 27 and 50: two rounds, and the windows of two texts that differ only behind 40 symbols."""
    rng = np.random.default_rng(17)
    method, rounds, split = suffixarrays.Transforms(50), [], suffixarrays.split
    text = rng.permutation(100).astype(np.uint8)[:84] + np.uint8(33)
    other = text.copy()
    other[40:] = text[40:][::-1]
    order, body = zip(*(method.encode(np.concatenate([x, y]), np.array([0, 84, 168]), np.zeros(2, np.int64)) for x, y in ((text, other), (other, text))))
    monkeypatch.setattr(suffixarrays, "split", lambda *a: rounds.append(1) or split(*a))
    best, _ = method.decide(np.concatenate(body), np.full(4, 35), np.array([0, 0, 1, 1]), np.array([3, 4, 4, 3])[np.concatenate([order[0], order[1] + 2])], np.zeros(4, np.int64))
    assert len(rounds) == 2 and sorted(best.tolist()) == [3] * 70 + [4] * 70


# -- 4 hosts


def test_urls(spark):
    rows = [
        (1, "http://Good.Example.org/en/2?x", '<a href="http://Bad.com/">'), (2, "https://sub.example.org/en/17", ""), (3, "x", None), (4, None, None), (5, "http://a.com/de/1", '<a class=x href=//evil.net/p>'),
        (6, "http://evil.net", ""), (7, "http://bad.com:80/q", ""), (8, "http://friend.net#f", ""), (9, "http://good.example.org/zz", "<a href='https://friend.net/1'>"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash"))
    rules = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
    got = {r["page_id"]: r for r in urls.judge(pages, rules).collect()}
    assert [got[i]["host"] for i in range(1, 10)] == ["good.example.org", "sub.example.org", "", "", "a.com", "evil.net", "bad.com:80", "friend.net", "good.example.org"]
    assert [got[i]["rule"] for i in range(1, 6)] == ["org/", "example.org/en/1", None, None, "com/de/"]
    assert got[8]["trust"] > 0 and got[6]["distrust"] == 0  # trust flows along links, distrust only against them
    assert (got[2]["verdict"], got[3]["verdict"], got[8]["verdict"], got[7]["verdict"]) == ("block", "allow", "allow", "allow")
    many = [*rules, *((f"h{i}.net/", "block") for i in range(80))]
    again = {r["page_id"]: (r["rule"], r["verdict"]) for r in urls.judge(pages, many).collect()}
    assert again == {i: (r["rule"], r["verdict"]) for i, r in got.items()}
    assert urls.judge(pages.limit(0), rules).count() == 0


def test_distrust_reversed(spark):
    pages = spark.createDataFrame([(1, "http://spam.com/de/1", ""), (2, "http://fan.net/", '<a href="http://spam.com/">'), (3, "http://far.net/", '<a href="http://fan.net/">')], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in urls.judge(pages, (("com/de/", "block"),)).collect()}
    assert got[2]["verdict"] == got[3]["verdict"] == "block" and got[2]["distrust"] == pytest.approx(0.15 * 0.85) and got[3]["distrust"] == pytest.approx(0.15 * 0.85**2)


def test_long_paths_and_cycles(spark):
    """A chain of 24 hosts in front of a blocked one, and a cycle of two, against the closed form; a bound that is too low is an error."""
    link = lambda h: f'<a href="http://{h}/">'
    rows = [(0, "http://spam.com/de/1", "")] + [(i, f"http://h{i}.net/", link(f"h{i - 1}.net" if i > 1 else "spam.com")) for i in range(1, 25)]
    rows += [(30, "http://a.org/", link("b.info")), (31, "http://b.info/", link("a.org"))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    rules = (("com/de/", "block"), ("org/", "allow"))
    got = {r["page_id"]: r for r in urls.judge(pages, rules).collect()}
    for i in range(1, 25):
        assert got[i]["verdict"] == "block" and got[i]["distrust"] == pytest.approx(0.15 * 0.85**i, abs=1e-8)
    assert got[30]["trust"] == pytest.approx(0.15 / (1 - 0.85**2), abs=1e-8) and got[31]["trust"] == pytest.approx(0.85 * 0.15 / (1 - 0.85**2), abs=1e-8)
    with pytest.raises(RuntimeError):
        urls.judge(pages, rules, iterations=10)


# -- 5 benchmark


def test_decontamination(spark, docs, monkeypatch):
    rows, df = docs
    rng = random.Random(9)
    texts = {i: t for i, t, *_ in rows if t}
    items = [(1, " ".join(texts[0].split()[:25]).upper()), (2, "short item"), (3, None), (4, "..."), (5, " ".join(f"u{rng.random()}" for _ in range(12))), (6, "Short, ITEM!")]
    extra = [(200, "A short, item. Short item short", "en", "a", 0), (201, "É" + " ".join(texts[0].split()[:12]) + "?!", "en", "a", 0)]
    df = df.unionByName(spark.createDataFrame(extra, SCHEMA))
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    grams = {}
    for i, t in items:
        w = word.findall((t or "").translate(low))
        n = min(len(w), 10)
        for p in range(len(w) - n + 1 if n else 0):
            grams.setdefault(tuple(w[p : p + n]), set()).add(str(i))
    want = Counter()
    for i, t, *_ in [*rows, *extra]:
        w, hit, found = word.findall((t or "").translate(low)), set(), set()
        for n in {len(g) for g in grams}:
            for p in range(len(w) - n + 1):
                if tuple(w[p : p + n]) in grams:
                    hit.update(range(p, p + n))
                    found |= grams[tuple(w[p : p + n])]
        want[(i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))] += 1
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert Counter(tuple(r) for r in decontaminate.report(df, bench).collect()) == want
    clean = decontaminate.clean(df, bench)
    assert clean.columns == df.columns and clean.count() == sum(n for k, n in want.items() if not k[5])
    cut_text = {r["doc_id"]: r["text"] for r in decontaminate.clean(df, bench, remove="spans").collect()}
    assert cut_text[200] == "A short" and cut_text[100] is None
    monkeypatch.setattr(decontaminate, "SET_WINDOWS", 2)  # the way beyond the bound
    assert Counter(tuple(r) for r in decontaminate.report(df, bench).collect()) == want
    monkeypatch.undo()
    assert decontaminate.report(df, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.report(empty(spark), bench).count() == 0


@pytest.mark.parametrize("bound", [20_000, 2])
def test_decontamination_verified(spark, monkeypatch, bound):
    """Windows that differ in non-ASCII case only are candidates, not hits, on both sides of the bound."""
    monkeypatch.setattr(decontaminate, "SET_WINDOWS", bound)
    bench = spark.createDataFrame([(1, "das größte über den École alle"), (2, "one two three four five six")], "item_id long, text string")
    rows = [(1, "vor DAS GRÖßTE ÜBER DEN éCOLE ALLE nach"), (2, "so one two THREE, four five end"), (3, "x das größte Über den École alle / two three four five six y"), (4, None), (5, "nothing"), (2, "so one two THREE, four five end")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("w", F.lit("clash"))
    assert sorted(r["doc_id"] for r in decontaminate.clean(df, bench, n=5).collect()) == [1, 4, 5]
    told = Counter((r["doc_id"], r["contaminated"], r["n_hit"]) for r in decontaminate.report(df, bench, n=5).collect())
    assert told == Counter({(1, False, 0): 1, (2, True, 5): 2, (3, True, 5): 1, (4, False, 0): 1, (5, False, 0): 1})
    cut_text = sorted((r["doc_id"], r["text"] or "-") for r in decontaminate.clean(df, bench, n=5, remove="spans").collect())
    assert cut_text == [(1, rows[0][1]), (2, "so end"), (2, "so end"), (3, "x das größte Über den École alle y"), (4, "-"), (5, "nothing")]


# -- 6 classifier


def test_classifier(spark):
    rng = random.Random(6)
    good = lambda: " ".join("".join(rng.choices("abcdefg", k=5)) for _ in range(40))
    bad = lambda: " ".join("".join(rng.choices("abcdefg", k=5)) + rng.choice(["***", "$$$"]) for _ in range(40))
    rows = [(i, good() if i % 3 else bad(), "en", "a", 0) for i in range(300)] + [(900, None, "en", "a", 0), (901, "", "en", "a", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(300)] + [(5, None, 0), (7777, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(*quality.split(docs, labels))
    got = {r["doc_id"]: r for r in quality.score(docs, model).collect()}
    assert all(got[i]["predicted"] == int(i % 3 > 0) for i in range(300))
    assert 0 <= got[900]["score"] == got[901]["score"] <= 1
    again = quality.train(*quality.split(docs.repartition(7), labels))
    assert np.allclose(model.product, again.product)
    none = quality.train(*quality.split(docs, labels.limit(0)))
    assert {r["score"] for r in quality.score(docs, none).collect()} == {0.5}


def py_mix(h):
    m = (1 << 64) - 1
    h = ((h ^ h >> 31) * 0x9E3779B97F4A7C15) & m
    h = ((h ^ h >> 27) * 0x94D049BB133111EB) & m
    return h ^ h >> 31


def py_features(text):
    """Places of the byte 1- to 3-grams and of the words of a text, one by one."""
    from clausewright.llm.text import BYTE_HASH

    m, out = (1 << 64) - 1, set()
    b = text.encode()
    for n in (1, 2, 3):
        for p in range(len(b) - n + 1):
            h = n
            for x in b[p : p + n]:
                h = (h * 0x9FB21C651E98DF25 + int(BYTE_HASH[x])) & m
            out.add(py_mix(h) >> 64 - quality.BITS)
    for w in WORDS.findall(text):
        x = w.encode()
        h = int(Slice(np.frombuffer(x, np.uint8), np.array([0, len(x)])).word_hashes()[0])
        out.add(py_mix(h ^ 0x5851F42D4C957F2D) >> 64 - quality.BITS)
    return out


def test_classifier_by_hand(spark, tmp_path):
    """Class ratios counted apart, the dual solution against a plain solver, and scores put together from them."""
    rng = random.Random(16)
    words = ["".join(rng.choices("abcdeé", k=rng.randint(2, 6))) for _ in range(80)]
    texts = [" ".join(rng.choices(words[:60] if i % 2 else words[20:], k=rng.choice([0, 3, 12, 30]))) for i in range(90)]
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in enumerate(texts)], SCHEMA)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(90)], "doc_id long, quality int, toxic int")
    labelled, sample = quality.split(docs, labels)
    learnt = sorted(r["r_id"] for r in labelled.collect())
    assert learnt == sorted(r["r_id"] for r in sample.collect()) == [i for i in range(90) if zlib.crc32(str(i).encode()) % 5]
    model = quality.train(labelled, sample)
    found = [py_features(t) for t in texts]
    count, n = np.ones((2, 1 << quality.BITS)), [0, 0]
    for i in learnt:
        n[i % 2] += 1
        count[i % 2][list(found[i])] += 1
    ratio = np.log(count[1] / (n[1] + 2)) - np.log(count[0] / (n[0] + 2))
    assert np.allclose(np.sqrt(model.square), abs(ratio))
    # a plain solver of the same problem: the dual by projected gradient steps
    used = sorted(set().union(*found))
    at = {f: k for k, f in enumerate(used)}
    x = np.zeros((len(learnt), len(used) + 1))
    for r, i in enumerate(learnt):
        x[r, [at[f] for f in found[i]]] = ratio[sorted(found[i], key=at.get)] if found[i] else 0
        x[r, [at[f] for f in found[i]]] = [ratio[f] for f in found[i]]
        x[r] /= np.sqrt((x[r] ** 2).sum()) or 1
        x[r, -1] = 1
    y = np.array([1.0 if i % 2 else -1.0 for i in learnt])
    q = (x * y[:, None]) @ (x * y[:, None]).T
    a, step = np.zeros(len(y)), 1 / np.linalg.eigvalsh(q)[-1]
    for _ in range(20000):
        a = np.clip(a - step * (q @ a - 1), 0, 1)
    primal = lambda w: 0.5 * w @ w + np.maximum(0, 1 - y * (x @ w)).sum()
    best = primal((a * y) @ x)
    w, bias = quality.hinge([np.array(sorted(found[i]), np.int64) for i in learnt], y, ratio, epochs=400)
    got = primal(np.append(w[used], bias))
    assert got <= best * 1.01 + 1e-6 and abs(best - (a.sum() - 0.5 * a @ q @ a)) < 0.01 * best
    # the scores of the fitted model, from its weights
    scores = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    for i in range(90):
        f = sorted(found[i])
        norm = np.sqrt((ratio[f] ** 2).sum()) or 1
        margin = sum(model.product[f]) / norm + model.bias
        assert scores[i] == pytest.approx(1 / (1 + np.exp(-(model.slope * margin + model.offset))))


def test_classifier_held_out(spark):
    """On the labelled rows of the test tables: held-out labels, lang, source and doc_id change nothing, and the score tells the classes apart."""
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = quality.train(*quality.split(docs, labels))
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    other = quality.train(*quality.split(docs.withColumns({"lang": F.lit("x"), "source": F.lit("y")}), labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))))
    assert np.array_equal(model.product, other.product) and (model.bias, model.slope, model.offset) == (other.bias, other.slope, other.offset)
    moved = quality.score(docs.withColumn("doc_id", F.col("doc_id") + 7), model).select(F.col("doc_id") - 7, "score").collect()
    rows = quality.score(docs, model)
    assert sorted(map(tuple, moved)) == sorted(map(tuple, rows.select("doc_id", "score").collect()))
    got = rows.join(labels, "doc_id").where(held).where("quality IS NOT NULL").select("quality", "score", "predicted").toPandas()
    one, zero = got[got.quality == 1].score.to_numpy(), got[got.quality == 0].score.to_numpy()
    area = (one[:, None] > zero[None, :]).mean() + 0.5 * (one[:, None] == zero[None, :]).mean()
    assert len(one) > 5 and len(zero) > 5 and area > 0.8, (len(one), len(zero), area)


def test_classifier_sample_is_bounded(spark):
    """A labelled id on very many rows trains on one of them."""
    rows = [(5 if i else 6, f"text {i}", "en", "a", 0) for i in range(3000)] + [(i, f"other {i}", "en", "a", 0) for i in range(100, 140)]
    labels = [(i, i % 2, 0) for i in [5, 6, *range(100, 140)]] + [(5, 1, 0)]
    df, known = spark.createDataFrame(rows, SCHEMA).withColumns({"r_id": F.lit(1), "label": F.lit(2), "quality": F.lit(3)}), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    labelled, sample = quality.split(df, known, max_train=12)
    assert labelled.count() > 2900 and sample.count() <= 12 and sample.groupBy("r_id", "label").count().where("count > 1").count() == 0


# -- 7 mixing


def test_mixing(spark):
    rng = random.Random(7)
    rows = [(i, "w " * (rng.choice([1, 30, 200]) if i % 97 else 4000), "en", rng.choices(["a", "b", "c", None], [60, 5, 20, 15])[0], 0) for i in range(3000)]
    rows += [(5000, None, "en", "a", 0), (5000, None, "en", "a", 0), (None, "x y", "en", "b", 0), (5001, "", "en", "empty", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = mixing.mix(df).collect()
    assert len(out) == len(rows)
    size = Counter()
    for r in rows:
        size[r[3]] += len((r[1] or "").split())
    total = sum(size.values())
    names = sorted((x for x in size if x is not None)) + [None]
    weight = {x: [1, 2, 3][i % 3] for i, x in enumerate(names)}
    capped, target = set(), {}
    while True:
        left = total - sum(3 * size[x] for x in capped)
        target = {x: 3 * size[x] if x in capped else left * weight[x] / sum(weight[y] for y in names if y not in capped) for x in names}
        over = {x for x in names if x not in capped and target[x] > 3 * size[x]}
        if not over:
            break
        capped |= over
    taken = Counter()
    for r in out:
        assert r["target"] == pytest.approx(target[r["source"]]) and r["source_size"] == size[r["source"]]
        assert r["taken"] == r["size"] * r["copies"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    for x in names:
        assert abs(taken[x] - target[x]) <= max(0.01 * target[x], 1)
    assert sorted(map(repr, out)) == sorted(map(repr, mixing.mix(df.repartition(3)).collect()))
    assert mixing.mix(empty(spark)).count() == 0


def test_mixing_fold(spark):
    """The fold against a plain one with the same draws."""
    rng = random.Random(17)
    items = sorted(((rng.choice([1, 2, 5, 40, 300]), rng.getrandbits(40), 0, i, rng.randint(0, 2), rng.uniform(0.05, 0.95)) for i in range(14)), reverse=True)
    table = spark.createDataFrame(items, "size long, key long, row long, doc_id int, base long, p double")
    pairs = table.alias("a").join(table.alias("b"), F.col("a.key") != F.col("b.key")).select("a.key", "b.key", session.uniform("a.key", "a.row", "b.key", "b.row", seed=3))
    draw = {(a, b): u for a, b, u in pairs.collect()}
    done, rest = {}, None
    for size, key, _, i, base, p in items:
        if rest is None:
            rest = [size, key, i, base, p]
            continue
        b = [size, key, i, base, p]
        up, down = min(rest[0] * (1 - rest[4]), size * p), min(rest[0] * rest[4], size * (1 - p))
        gain = up if draw[rest[1], key] * (up + down) < down else -down
        rest[4] += gain / rest[0]
        b[4] -= gain / size
        left = []
        for x in (rest, b):
            if 1e-9 <= x[4] <= 1 - 1e-9:
                left.append(x)
            else:
                done[x[2]] = x[3] + round(x[4])
        assert len(left) <= 1
        rest = left[0] if left else None
    row = table.groupBy().agg(F.sort_array(F.collect_list(F.struct("size", "key", "row", "doc_id", "base", "p")), False).alias("x")).select(mixing._fold(F.col("x"), "int", 3).alias("f")).first()["f"]
    assert {d["doc_id"]: d["copies"] for d in row["done"]} == done and (row["rest"] is None) == (rest is None)
    assert rest is None or row["rest"]["doc_id"] == rest[2] and row["rest"]["p"] == pytest.approx(rest[4])
    words = sum(i[0] * (i[4] + i[5]) for i in items)
    size = {i[3]: i[0] for i in items}
    assert sum(size[i] * c for i, c in done.items()) + (rest[0] * (rest[3] + rest[4]) if rest else 0) == pytest.approx(words)


def test_mixing_expectations(spark):
    """Over 600 sources of the same documents: copies are the rate on average, its floor or ceiling, and sums near the target."""
    sizes = [2000, 1500, 900, 300, 290, 280, 60, 55, 50, 50, 20, 7, 7, 6, 5, 4, 3, 2, 1, 1]
    df = spark.range(len(sizes)).select("id", F.element_at(F.array(*map(F.lit, sizes)), (F.col("id") + 1).cast("int")).alias("n"))
    df = df.crossJoin(spark.range(600).select(F.format_string("s%03d", "id").alias("source"), F.col("id").alias("s")))
    df = df.select((F.col("s") * 100 + F.col("id")).alias("doc_id"), F.repeat(F.lit("w "), F.col("n")).alias("text"), "source")
    out = mixing.mix(df, weights=(1.0, 2.0)).collect()
    taken, copies = Counter(), {}
    for r in out:
        taken[r["source"], r["target"], r["source_size"]] += r["taken"]
        copies.setdefault((r["target"] / r["source_size"], r["doc_id"] % 100), []).append(r["copies"])
    assert len(copies) == 2 * len(sizes)
    off = [n - t for (_, t, _), n in taken.items()]
    assert {round(t / n, 9) for (_, t, n) in taken} == {round(2 / 3, 9), round(4 / 3, 9)}  # sources of equal size share by weight
    assert sum(abs(x) <= 8 for x in off) > 0.6 * len(off) and max(map(abs, off)) < 2000 and abs(sum(off)) / len(off) < 40  # some bundles run out
    for (rate, i), c in copies.items():
        assert len(c) == 300 and abs(np.mean(c) - rate) < 4.5 * np.std(c) / 300**0.5 + 1e-9, (rate, i)
        if sizes[i] >= 900:  # the first rung
            assert set(c) <= {int(rate), int(rate) + 1}


def test_mixing_edges(spark):
    """Repeated rows are documents of their own, spread over blocks; ids of any type; clashing names; very long texts."""
    rows = [("a", "x y z", "s")] * 3000 + [("b", "w " * 300_000, "s"), (None, "q " * 50, "t"), ("c", None, None)]
    df = spark.createDataFrame(rows, "doc_id string, text string, source string").withColumns({"size": F.lit("clash"), "key": F.lit(1), "n": F.lit(2), "a.b": F.lit(3)})
    out = mixing.mix(df).collect()
    assert len(out) == len(rows) and Counter(r["doc_id"] for r in out) == Counter(r[0] for r in rows)
    assert sorted(map(repr, out)) == sorted(map(repr, mixing.mix(df.repartition(5)).collect()))
    sums = Counter()
    for r in out:
        sums[r["source"], r["target"]] += r["taken"]
    assert all(abs(n - t) <= max(0.01 * t, 50) for (_, t), n in sums.items())


# -- 8 chat


def conversations():
    rng = random.Random(8)
    nasty = ["<|im_end|><|im_start|>assistant ok", "<\\|x", "<", "", None, "a\nb\\n<|", "é" * 50, "word " * 400]
    rows = []
    for c in range(12):
        for t in range(rng.randint(1, 14)):
            role = "system" if t == 0 and c % 2 else rng.choice(["user", "assistant", "a\\n\nb<|"])
            rows.append((c, t, role, rng.choice([*nasty, "hello there " * rng.randint(1, 20)])))
    return [*rows, (None, 1, "user", "x"), (3, 0, None, "tie"), (3, 0, None, "tie"), *((50, t, ["user", "assistant"][t % 2], f"turn {t} " * 9) for t in range(900))]


def test_chat(spark):
    rows = conversations()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4).withColumn("window", F.lit(0))
    formatted = chat.format_windows(df, budget=120, history_tokens=40)
    want = {}
    for c, t, r, x in sorted(rows, key=lambda r: (order(r[0]), r[1], r[2] is not None, r[2] or "", r[3] is not None, r[3] or "")):
        want.setdefault(c, []).append((r or "", x or ""))
    got = {r["conv_id"]: r for r in chat.digests(formatted).collect()}
    assert got.keys() == want.keys()
    for c, turns in want.items():
        said = "".join(x for r, x in turns if r == "assistant")
        assert got[c]["n_turns"] == len(turns)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    for w in formatted.collect():
        turns = list(chat.read_turns(w["text"]))
        assert len(turns) == w["n_turns"]
        fixed = turns[0][0] == "system" and w["window"] > 0
        assert w["n_tokens"] <= 120 or w["n_turns"] - w["n_repeated"] == 1 and w["n_turns"] <= 1 + fixed
    assert sum(w["n_repeated"] > 0 for w in formatted.collect()) > 5
    assert chat.digests(chat.format_windows(df.limit(0))).count() == 0


def test_chat_vocabulary(spark):
    """The registered vocabulary: known counts, and texts of two million blanks or letters."""
    with open(queries.VOCABULARY, "rb") as f:
        count = chat.counter(f.read())
    one, two = count([" " * chat.BLANKS])[0], count([" " * (2 * chat.BLANKS)])[0]
    assert count(["", "a", "the the"]) == [0, 1, 2] and two == 2 * one and count(["x" + "\n" * 3000 + "y"])[0] > 2
    assert "".join(chat.parts(" " * 2500 + "a" + "\t" * 1000)) == " " * 2500 + "a" + "\t" * 1000 and [len(x) for x in chat.parts(" " * 2500 + "a")] == [1000, 1000, 501]
    long = [" " * 2_000_000, "\n" * 1_000_000 + "a" * 1000, "word " * 100_000, " \t\n" * 300_000]
    rows = [("c", 2 * t + k, ["user", "assistant"][k], x if k else "hi") for t, x in enumerate(long) for k in (0, 1)]
    df = spark.createDataFrame(rows, "conv_id string, turn long, role string, text string").withColumns({"window": F.lit(1), "loss": F.lit(2), "a.b": F.lit(3)})
    got = chat.digests(chat.format_windows(df, vocabulary=queries.VOCABULARY)).collect()
    said = "".join(long)
    assert len(got) == 1 and (got[0]["conv_id"], got[0]["n_turns"], got[0]["loss_chars"]) == ("c", 8, len(said))
    assert got[0]["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()


# -- 9 licences


def test_licenses(spark):
    mit = licenses.KNOWN["MIT"]
    rows = [(1, "Copyright (c) 2020 Someone\nAll rights reserved.\n\n" + mit.upper().replace(",", " ,")), (2, mit.replace("sublicense", "sublicence")), (3, mit + " more"), (4, None), (5, ""), (6, "Copyright 1999 x"), (6, "Copyright 1999 x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("license", F.lit("clash"))
    known = licenses.known_digests(spark)
    got = sorted((r["doc_id"], r["license"]) for r in licenses.scan(df, known).fillna("-", ["license"]).collect())
    assert got == [(1, "MIT"), (2, "MIT"), (3, "-"), (4, "-"), (5, "-"), (6, "-"), (6, "-")]
    assert licenses.scan(df, known.limit(0)).where("license IS NOT NULL").count() == 0
    assert licenses.scan(df.limit(0), known).count() == 0


def test_full_license_texts(spark):
    """Files as they are published, with and without title and appendix."""
    names = {k for k, _ in licenses.known_texts()}
    assert {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "BSD-2-Clause", "BSD-3-Clause", "MPL-2.0", "CC0-1.0", "Unlicense", "MIT", "ISC", "Zlib", "0BSD", "BSL-1.0"} <= names
    texts = {f.name.removesuffix(".txt"): f.read_text() for f in (resources.files(licenses.__package__) / "license_texts").iterdir()}
    apache, gpl, bsd = texts["Apache-2.0"], texts["GPL-3.0"], texts["BSD-3-Clause"]
    rows = [(k, v) for k, v in texts.items()] + [
        ("Apache-2.0", apache[: apache.index("APPENDIX")]), ("Apache-2.0", apache[apache.index("TERMS AND") :].replace("[yyyy] [name of copyright owner]", "2020 Someone")), ("GPL-3.0", gpl.replace("https:", "http:")),
        ("BSD-3-Clause", "Copyright (c) 2001, Someone\nAll rights reserved.\n\n" + re.sub(r"(?m)^[123]\.", "  *", bsd)), ("-", apache[: len(apache) // 2]), ("-", "a text. Released under the MIT License."),
    ]
    df = spark.createDataFrame([(i, k.split("~")[0], v) for i, (k, v) in enumerate(rows)], "doc_id long, want string, text string")
    got = licenses.scan(df, licenses.known_digests(spark)).join(df, "doc_id").fillna("-", ["license"])
    assert got.count() == len(rows) and [tuple(r) for r in got.where("license <> want").select("want", "license").collect()] == []


def test_wrapped_licenses(spark):
    """Line breaks before the word copyright, titles and statements leave the digest alone."""
    wrap = lambda text, n: "\n\n".join("\n".join(textwrap.wrap(p, n, break_on_hyphens=False, break_long_words=False)) for p in text.split("\n"))
    isc = wrap(licenses.KNOWN["ISC"], 76)
    assert "\ncopyright notice" in isc
    said = r"(?i)copyright[ \t]*(\(c\)|©|\[yyyy)|all rights reserved"
    rows = [(k, wrap(licenses.KNOWN[k], n)) for k in ("MIT", "ISC", "Zlib") for n in range(20, 110, 3)]
    for f in (resources.files(licenses.__package__) / "license_texts").iterdir():
        part = re.split(r"\n[ \t]*\n", f.read_text())
        flat = "\n".join(p if re.search(said, p) else " ".join(p.split()) for p in part)
        rows += [(f.name.removesuffix(".txt").split("~")[0], "\n".join(x if re.search(said, x) else wrap(x, n) for x in flat.split("\n"))) for n in (38, 60, 76)]
    for line in ("Copyright (c) 2020, Someone", "Copyright 1999-2003 A, B", "(C) 1995 Jean and Mark", "© The Authors", "Copyright (c) npm, Inc.", "copyright The Go Authors. All rights reserved.", "# Copyright: Someone", "Copyright © 2001 X\nCopyright Y\n(c) Copyright 2002 Z", "Copyright [yyyy] [name of copyright owner]"):
        rows += [("MIT", "MIT License\n\n" + line + "\n\n" + wrap(licenses.KNOWN["MIT"], 78)), ("ISC", "The ISC License\n\n" + line + "\n\n" + isc), ("Zlib", "zlib License\n\n" + line + "\n\n" + wrap(licenses.KNOWN["Zlib"], 70))]
    rows += [("MIT", "The MIT License (MIT)\n\nCopyright (c) 2014 X\n\n" + wrap(licenses.KNOWN["MIT"].upper(), 60)), ("-", "copyright notice"), ("-", "copyright holders and others\n" + isc)]
    df = spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(rows)], "doc_id long, want string, text string")
    got = licenses.scan(df, licenses.known_digests(spark)).join(df, "doc_id").fillna("-", ["license"])
    assert [tuple(r) for r in got.where("license <> want").select("doc_id", "want", "license", "text").collect()] == []
    assert got.where("text = 'copyright notice'").first()["canonical_words"] == 2


# -- 10 quality rules


def test_repetition(spark, docs):
    rows, df = docs
    rows = [*rows, (300, "same line here\n" * 40, "en", "a", 0), (301, "ab#*$ %&|<> " * 3, "en", "a", 0)]
    df = df.unionByName(spark.createDataFrame(rows[-2:], SCHEMA)).withColumn("n_words", F.lit("clash"))
    want = Counter()
    for i, t, *_ in rows:
        t = t or ""
        w = WORDS.findall(t)
        lines = [x for x in t.split("\n") if WORDS.search(x)]
        again = [x for k, x in enumerate(lines) if x in lines[:k]]
        chars = sum(map(len, w))

        def covered(n, later):
            grams = [tuple(w[p : p + n]) for p in range(len(w) - n + 1)]
            count, seen, out = Counter(grams), set(), set()
            for p, g in enumerate(grams):
                if (g in seen) if later else count[g] > 1:
                    out.update(range(p, p + n))
                seen.add(g)
            return out

        rep = len(covered(5, False))
        failed = len(w) < 10 or 100 * rep > 20 * len(w)
        bad = len(again) > 0.30 * len(lines) or sum(len(x) for y in again for x in WORDS.findall(y)) > 0.20 * chars
        bad |= any(sum(len(w[p]) for p in covered(n, True)) > most * chars for n, most in repetition.MAX_COVERAGE.items())
        want[(i, len(w), chars, len(re.findall(r"[#*$%&|<>]", t)), len(again), rep, failed, not failed and not bad)] += 1
    assert Counter(tuple(r) for r in repetition.score(df).collect()) == want
    assert repetition.keep(df).count() == sum(n for k, n in want.items() if k[-1])
    assert repetition.score(empty(spark)).count() == 0


def test_slices():
    import pyarrow as pa

    column = pa.chunked_array([["a b", None, "", "é  ü\n"], ["x" * 50]])
    parts = list(cut(column, 8))
    assert [s.words.tolist() for _, _, s in parts] == [[2, 0, 0], [2], [1]]
    s = Slice(np.frombuffer(b"ab ab b", np.uint8), np.array([0, 7]))
    h = s.word_hashes()
    assert h[0] == h[1] != h[2] and windows(h, 2)[0] != windows(h, 2)[1]


@pytest.mark.parametrize("bound", [20_000, 0])
def test_names_ids_and_length(spark, monkeypatch, bound):
    """Text ids, a null one, repeated rows, two megabytes in one text, and extra columns that clash with any inner name, on both sides of every switch."""
    for module, name in ((decontaminate, "SET_WINDOWS"), (quality, "BROADCAST_LABELS"), (licenses, "BROADCAST_ROWS"), (urls, "BROADCAST_HOSTS"), (mixing, "SOURCES")):
        monkeypatch.setattr(module, name, bound)
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefg", k=6)) for _ in range(4000)]
    long = " ".join(rng.choices(words, k=300_000))
    leak = long.split()[200_000:200_012]
    rows = [("a", long), (None, "x y"), ("b", licenses.KNOWN["ISC"]), ("b", licenses.KNOWN["ISC"]), ("c", "so " + " ".join(leak) + " on"), ("d", None), ("e", "")]
    clash = "w items _hits _t _key _w _h1 n h at item k id form digest license size row label r_id c0 c1 a.b count doc text2 src dst host rate page url_".split()
    df = spark.createDataFrame(rows, "doc_id string, text string").withColumns({c: F.lit(i) for i, c in enumerate(clash)}).withColumn("source", F.lit("s")).withColumn("url", F.lit("http://h.org/"))
    bench = spark.createDataFrame([("i", " ".join(leak))], "item_id string, text string").withColumn("item", F.lit(1)).withColumn("_t", F.lit(2))
    hit = Counter((r["doc_id"], r["contaminated"]) for r in decontaminate.report(df, bench).collect())
    assert hit == Counter({("a", True): 1, (None, False): 1, ("b", False): 2, ("c", True): 1, ("d", False): 1, ("e", False): 1})
    kept = decontaminate.clean(df, bench)
    assert kept.columns == df.columns and Counter(r["doc_id"] for r in kept.collect()) == Counter({None: 1, "b": 2, "d": 1, "e": 1})
    assert {tuple(r)[2:] for r in kept.collect()} == {(*range(len(clash)), "s", "http://h.org/")}
    spans = decontaminate.clean(df, bench, remove="spans")
    assert spans.columns == df.columns and {r["doc_id"]: r["text"] for r in spans.collect()}["c"] == "so on"
    labels = spark.createDataFrame([("a", 1), ("b", 0), ("c", 1), ("e", 0)], "doc_id string, quality int").withColumn("r_id", F.lit(1))
    scored = quality.score(df, quality.train(*quality.split(df, labels))).collect()
    assert len(scored) == len(rows) and all(0 <= r["score"] <= 1 for r in scored)
    found = Counter((r["doc_id"], r["license"]) for r in licenses.scan(df, licenses.known_digests(spark)).collect())
    assert found["b", "ISC"] == 2 and sum(found.values()) == len(rows) and found["a", None] == 1
    kept = repetition.keep(df)
    assert kept.columns == df.columns and repetition.score(df).count() == len(rows)
    assert {r["doc_id"]: r["n_words"] for r in repetition.score(df).collect()}["a"] == 300_000
    pages = urls.judge(df, (("org/", "block"),), id_col="doc_id", html_col="text").collect()
    assert len(pages) == len(rows) and {r["verdict"] for r in pages} == {"block"}
    assert len(mixing.mix(df).collect()) == len(rows)


def test_adjacent_spellings(spark):
    """Words with another spelling that follow each other, against a plain replacement word by word."""
    text = "Licence licence LICENCE favour favour; labour favour programme\nlicence"
    other = dict((a, b) for a, b in licenses.SPELLINGS if " " not in a)
    want = " ".join(other.get(w, w) for w in re.findall("[a-z]+", text.lower()))
    got = spark.createDataFrame([(text,)], "t string").select(licenses.canonical(F.col("t")).alias("c")).first()["c"]
    assert got == want == "license license license favor favor labor favor program license"
