"""Token alignment and fill-in-middle against plain Python, on texts that hold the awkward cases."""

from __future__ import annotations

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from clausewright.llm import alignment, fim, queries

A, B = queries.SIDE_A, queries.SIDE_B
TEXTS = [
    "The quick brown fox.", "a  b   c \n\n d\t\te ", " leading", "trailing ", "<|endoftext|> and <s> and <0x41>", "naïve café – 東京タワー 🎉👩‍👩‍👧", "é combining \u0000 nul", None, "",
    " ", "   ", "\n", "▁ mark", "x" * 5000, " " * 3000 + "end", "don't we'll I'M 3.14 1,000", "a b c \u0085 d\u001ce", "ﬁ ligature Å", "The quick brown fox.", "word " * 400 + "tail",
    "it's  the\r\nend", "<P>x<S>", "<M>", "a<b<S y", "\U0001f600" * 300,
]
ROWS = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(3, "repeated id", "y"), (None, "no id", "z"), (None, None, "z")]
SCHEMA = "doc_id long, text string, key string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


def encoded(text):
    """Tokens of whole texts by both libraries, with the bytes of each."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    p = SentencePieceProcessor(model_file=B)
    letters = alignment.byte_letters()
    a = t.encode(" " + text, add_special_tokens=False).ids
    b = p.encode(text)
    said_a = [bytes(letters[c] for c in t.id_to_token(i)) for i in a]
    said_b = [bytes([int(x[3:5], 16)]) if p.is_byte(i) else x.replace("▁", " ").encode() for i, x in ((i, p.id_to_piece(i)) for i in b)]
    return a, b, said_a, said_b


def walked(text):
    """Groups and links by two pointers over one text."""
    if not text:
        return [], []
    a, b, said_a, said_b = encoded(text)
    if not b"".join(said_a) == b"".join(said_b) == (" " + text).encode():
        return [], []
    groups, links, i, j, end_a, end_b, open_a, open_b = [], [], 0, 0, len(said_a[0]), len(said_b[0]), [a[0]], [b[0]]
    while True:
        links.append((a[i], b[j]))
        if end_a == end_b:
            groups.append((open_a, open_b))
            i, j = i + 1, j + 1
            if i == len(a):
                return groups, links
            open_a, open_b = [a[i]], [b[j]]
            end_a, end_b = end_a + len(said_a[i]), end_b + len(said_b[j])
        elif end_a < end_b:
            i += 1
            open_a.append(a[i])
            end_a += len(said_a[i])
        else:
            j += 1
            open_b.append(b[j])
            end_b += len(said_b[j])


@pytest.mark.parametrize("bound", [1_000_000, 0])
def test_alignment(spark, docs, bound):
    each = [walked(t) for _, t, _ in ROWS]
    n = Counter(x for _, links in each for x in links)
    peak = {}
    for (_, b), c in n.items():
        peak[b] = max(peak.get(b, 0), c)
    want = []
    for (i, _, _), (groups, links) in zip(ROWS, each):
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        digest = hashlib.sha256(said.encode()).hexdigest() if groups else ""
        want.append((i, sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(links), sum(n[x] == peak[x[1]] for x in links), sum(n[x] for x in links), digest))
    found = alignment.align(docs, A, B, broadcast_pairs=bound)
    got = [tuple(r) for r in found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert sum(not x[1] for x in got) == 4 and dict(found.dtypes)["count_sum"] == "bigint"  # null, empty, null, and the mark that is read as a space


def test_alignment_groups(spark, docs):
    got = [(r.doc_id, [(list(g.a), list(g.b)) for g in r.groups]) for r in alignment.groups(docs, A, B).collect()]
    want = [(i, [(list(x), list(y)) for x, y in walked(t)[0]]) for i, t, _ in ROWS]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_segments_are_the_text(monkeypatch):
    """Tokens by segment equal those of whole texts, also when little is remembered."""
    with open(A, "rb") as a, open(B, "rb") as b:
        encoder = alignment.Encoder(a.read(), b.read())
    assert encoder.by_segment
    monkeypatch.setattr(alignment, "REMEMBERED", 50)
    for _ in range(2):
        for t in TEXTS:
            ids_a, n_a, ids_b, n_b = encoder.encode([t or "", "between"])
            a, b, said_a, said_b = encoded(t or "")
            if t and b"".join(said_b) == (" " + t).encode():
                assert list(ids_a[: n_a[0]]) == a and list(ids_b[: n_b[0]]) == b
            else:
                assert n_a[0] == n_b[0] == 0 and n_a[1]


def test_alignment_other_columns_and_empty(spark):
    named = spark.createDataFrame([("k1", "some words", 1, 2), ("k2", None, 3, 4)], "n_a string, n string, links long, a int")
    got = {r.doc_id: r.n_a for r in alignment.align(named, A, B, "n_a", "n").collect()}
    assert got["k1"] == 2 and got["k2"] == 0
    nothing = spark.createDataFrame([], SCHEMA)
    assert alignment.align(nothing, A, B).count() == 0 == fim.transform(nothing).count()


def cut(i, text):
    h = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    text = text or ""
    n = len(text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return (i, n, "plain", None, None, text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    form = "spm" if h4 % 100 < 20 else "psm"
    return (i, n, form, a, b - a, f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}")


def test_fill_in_middle(spark):
    rows = [(i, TEXTS[i % len(TEXTS)], "x") for i in range(150)] + ROWS[-3:]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    out = fim.transform(docs)
    got = [tuple(r) for r in out.collect()]
    assert sorted(got, key=repr) == sorted((cut(i, t) for i, t, _ in rows), key=repr)
    assert {x[2] for x in got} == {"plain", "psm", "spm"}
    back = out.select("doc_id", fim.restored(F.col("output"), F.col("form")).alias("text")).collect()
    assert sorted(map(tuple, back), key=repr) == sorted(((i, t or "") for i, t, _ in rows), key=repr)


def test_fill_in_middle_options(spark):
    docs = spark.createDataFrame([(f"k{i}", "some text of words", 1) for i in range(40)], "form string, n string, output int")
    forms = lambda **x: {r.form for r in fim.transform(docs, "form", "n", **x).collect()}
    assert forms(changed=0) == {"plain"} and forms(changed=100, suffix_first=100) == {"spm"} and forms(changed=100, suffix_first=0) == {"psm"}
    assert fim.transform(docs, "form", "n", seed=2).exceptAll(fim.transform(docs, "form", "n")).count()


def test_cuts_across_segments():
    text = "ab\U0001f600\né" * 400
    cuts = fim.Cuts(text, fim.Split(fim.Regex(fim._ONE), "isolated"))
    assert cuts.n == len(text) > 3 * fim.SEGMENT
    assert [cuts.offset(k) for k in (0, 1, fim.SEGMENT - 1, fim.SEGMENT, fim.SEGMENT + 1, cuts.n - 1, cuts.n)] == [0, 1, fim.SEGMENT - 1, fim.SEGMENT, fim.SEGMENT + 1, cuts.n - 1, cuts.n]
