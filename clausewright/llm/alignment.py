"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes.

Both tokenizers cut the same bytes (a space and the text). A two-pointer merge of the
cumulative ends of their tokens, in Arrow batches, gives the places where both end, which cut the tokens into
groups, and the links, the pairs of tokens whose ranges overlap: each stretch between two
neighbouring ends is one link. Every text returns its distinct pairs of ids with their
numbers. Spark sums these over the corpus, takes the maximum of each B id, and joins both back.

Tokenizers run on segments, each distinct one once as long as a task remembers it. A segment starts at a
space that follows a visible character. Neither vocabulary has a token across such a place: a byte-level pattern
takes a space only in front, and the pieces of the other model hold none behind another character (looked up in
the vocabulary, whole texts are encoded otherwise); merges therefore never cross it, and the segments' tokens are those of the text.

The texts' rows, with their pairs, are written once to the shared folder. The table of summed pairs is
broadcast if it has at most ``BROADCAST_PAIRS`` rows (counted first), else joined by sort and merge, where Spark splits a hot pair.

Defined cases: a null or empty text, and one whose joined tokens differ from its bytes, have no
tokens: zeros and an empty digest; ids may be null, repeat and be of any type, each row counts for itself; strings of special tokens inside a text
are plain text; a text of any length is encoded whole, in one task; ties for the highest count all count; an
empty table gives no rows; extra columns, whatever their names, are left alone.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import written
from .session import named
from .text import flat, slices, trimmed

BROADCAST_PAIRS = 1_000_000
#: Tokens of segments that a task remembers.
REMEMBERED = 1 << 21
SEGMENTS = re.compile(r"(?s)(?<=[!-~\w])(?= .)")
SPACE = "▁"
COLUMNS = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
LINKS = "array<struct<a:int,b:int,n:int>>"


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: visible ones stand for themselves, the rest follow from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in seen]
    return {chr(b): b for b in seen} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteLevel:
    """Side A: a byte-level vocabulary in the format of the tokenizers library."""

    def __init__(self, content: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        spec = json.loads(content)
        self.encoder = Tokenizer.from_buffer(content)
        self.encoder.encode_special_tokens = True
        letters = byte_letters()
        vocabulary = self.encoder.get_vocab(with_added_tokens=True)
        self.bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        pre = spec.get("pre_tokenizer") or {}
        self.by_segment = not spec.get("normalizer") and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.encoder.encode_batch_fast(texts, add_special_tokens=False)]


class Pieces:
    """Side B: a sentencepiece model that adds the space itself."""

    def __init__(self, content: bytes):
        from sentencepiece import SentencePieceProcessor

        self.encoder = p = SentencePieceProcessor(model_proto=content)
        names = [p.id_to_piece(i) for i in range(p.get_piece_size())]
        self.bytes = [bytes([int(x[3:5], 16)]) if p.is_byte(i) else x.replace(SPACE, " ").encode() for i, x in enumerate(names)]
        probe = " a  b  ﬁ "
        self.by_segment = not any(SPACE in x.lstrip(SPACE) for x in names) and p.normalize(probe) == (" " + probe).replace(" ", SPACE)

    def encode(self, texts: list[str]) -> list[list[int]]:
        """texts start with the space that the model adds."""
        return self.encoder.encode([x[1:] for x in texts], num_threads=1)


class Side:
    """Tokens of remembered segments, in one array."""

    def __init__(self, vocabulary: ByteLevel | Pieces):
        self.vocabulary = vocabulary
        self.size = np.array([len(x) for x in vocabulary.bytes], np.int64)
        self.forget()

    def forget(self) -> None:
        self.ids, self.off = np.zeros(0, np.int64), np.zeros(1, np.int64)

    def learn(self, segments: list[str]) -> list[bool]:
        """Encodes segments; whether the joined tokens of each are its bytes."""
        found = self.vocabulary.encode(segments)
        n = np.fromiter(map(len, found), np.int64, len(found))
        self.ids = np.concatenate([self.ids, *(np.array(x, np.int64) for x in found)])
        self.off = np.concatenate([self.off, self.off[-1] + np.cumsum(n)])
        return [b"".join(map(self.vocabulary.bytes.__getitem__, x)) == s.encode() for x, s in zip(found, segments)]

    def tokens(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a row of segments, and how many each segment has."""
        n = self.off[at + 1] - self.off[at]
        return self.ids[np.repeat(self.off[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())], n


class Encoder:
    """Both sides' tokens of texts."""

    def __init__(self, a: bytes, b: bytes):
        self.a, self.b = Side(ByteLevel(a)), Side(Pieces(b))
        self.by_segment = self.a.vocabulary.by_segment and self.b.vocabulary.by_segment
        self.known: dict[str, int] = {}
        self.good: list[bool] = []

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids and numbers by text, of A and of B; none for texts that are empty or not rebuilt."""
        if len(self.a.ids) + len(self.b.ids) > REMEMBERED:
            self.known, self.good = {}, []
            self.a.forget()
            self.b.forget()
        cut = [(SEGMENTS.split(" " + t) if self.by_segment else [" " + t]) if t else [] for t in texts]
        new = list({s for parts in cut for s in parts if s not in self.known})
        if new:
            self.known |= {s: len(self.good) + k for k, s in enumerate(new)}
            self.good += [x and y for x, y in zip(self.a.learn(new), self.b.learn(new))]
        known = self.known
        at = np.array([known[s] for parts in cut for s in parts], np.int64)
        doc = np.repeat(np.arange(len(texts)), list(map(len, cut)))
        bad = np.zeros(len(texts), bool)
        bad[doc[~np.array(self.good, bool)[at]]] = True
        at, doc = at[~bad[doc]], doc[~bad[doc]]
        out = []
        for side in (self.a, self.b):
            ids, n = side.tokens(at)
            out += [ids, np.bincount(doc, weights=n, minlength=len(texts)).astype(np.int64)]
        return tuple(out)


class Merge:
    """The groups and links of texts whose tokens follow each other, in both orders of tokens the same bytes."""

    def __init__(self, a: np.ndarray, ends_a: np.ndarray, b: np.ndarray, ends_b: np.ndarray):
        self.a, self.b = a, b
        mark = np.zeros(int(ends_a[-1]) + 1 if len(a) else 1, np.uint8)
        mark[ends_a] |= 1
        mark[ends_b] |= 2
        self.ends = np.flatnonzero(mark)
        mark = mark[self.ends]
        in_a, in_b = mark & 1, mark >> 1
        both = mark == 3
        #: token of each side by link, and the tokens of each side up to the end of each group
        self.link_a, self.link_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
        self.upto_a, self.upto_b = np.cumsum(in_a, dtype=np.int64)[both], np.cumsum(in_b, dtype=np.int64)[both]
        self.group_ends = self.ends[both]

    def written(self, digits_a: np.ndarray, digits_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All groups as a1,a2|b1;... in bytes, padded by zeros, one row per token; and the rows up to the end of each group."""
        n = len(self.a) + len(self.b)
        out = np.zeros((n, digits_a.shape[1] + 1), np.uint8)
        out[:, -1] = ord(",")
        size_a, size_b = np.diff(self.upto_a, prepend=0), np.diff(self.upto_b, prepend=0)
        out[np.arange(len(self.a)) + np.repeat(self.upto_b - size_b, size_a), :-1] = digits_a[self.a]
        out[np.arange(len(self.b)) + np.repeat(self.upto_a, size_b), :-1] = digits_b[self.b]
        upto = self.upto_a + self.upto_b
        out[upto - size_b - 1, -1] = ord("|")
        out[upto - 1, -1] = ord(";")
        return out, upto


def digits(n: int, width: int) -> np.ndarray:
    """Decimal texts of 0 to n - 1 as rows of bytes, padded by zeros."""
    return np.array([str(k).encode() for k in range(n)], f"S{width}").view(np.uint8).reshape(n, width)


def measure(encoder: Encoder, texts: list[str], digits_a: np.ndarray, digits_b: np.ndarray) -> tuple[dict[str, list | np.ndarray], list[bytes], pa.Array]:
    """The columns of COLUMNS, the groups as text, and the distinct pairs of ids with their numbers, by text."""
    a, n_a, b, n_b = encoder.encode(texts)
    ends_a, ends_b = np.cumsum(encoder.a.size[a]), np.cumsum(encoder.b.size[b])
    m = Merge(a, ends_a, b, ends_b)
    upto_a = np.cumsum(n_a)
    stop = np.concatenate([[0], ends_a])[upto_a]  # the byte after each text
    groups, links = np.searchsorted(m.group_ends, stop, "right"), np.searchsorted(m.ends, stop, "right")
    rows, upto = m.written(digits_a, digits_b)
    row = np.concatenate([[0], upto])[groups]
    said = [rows[x:y].tobytes().translate(None, b"\0")[:-1] for x, y in zip([0, *row], row)]
    size = len(encoder.b.size)
    doc = np.repeat(np.arange(len(texts)), np.diff(links, prepend=0))
    key, n = np.unique(doc * (size * len(encoder.a.size)) + a[m.link_a] * size + b[m.link_b], return_counts=True)
    doc, key = np.divmod(key, size * len(encoder.a.size))
    off = np.searchsorted(doc, np.arange(len(texts) + 1))
    pairs = pa.StructArray.from_arrays([pa.array(x.astype(np.int32)) for x in (key // size, key % size, n)], ["a", "b", "n"])
    columns = {
        "n_a": n_a, "n_b": n_b, "n_groups": np.diff(groups, prepend=0), "n_links": np.diff(links, prepend=0),
        "groups_sha256": [hashlib.sha256(s).hexdigest() if k else "" for s, k in zip(said, n_a)],
    }
    return columns, said, pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pairs)


def _content(docs: DataFrame, path: str):
    """A vocabulary file of the driver, broadcast: a few MB."""
    with open(path, "rb") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())


def _mapped(docs: DataFrame, id_col: str, text_col: str, a_path: str, b_path: str, schema: str, row: Callable) -> DataFrame:
    rows = named(docs, doc_id=id_col, text=text_col)
    a, b = _content(docs, a_path), _content(docs, b_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, seen = None, TaskContext.get().partitionId() << 33
        for batch in batches:
            if encoder is None:
                encoder = Encoder(a.value, b.value)
                width = len(str(max(len(encoder.a.size), len(encoder.b.size))))
                tables = digits(len(encoder.a.size), width), digits(len(encoder.b.size), width)
            _, off = flat(batch.column(1))
            for x, y in slices(off):
                part = batch.slice(x, y - x)
                columns, said, pairs = measure(encoder, [t or "" for t in part.column(1).to_pylist()], *tables)
                keys = pa.array(np.arange(seen, seen + len(part)))
                seen += len(part)
                arrays, names = row(part.column(0), keys, columns, said, pairs)
                yield pa.RecordBatch.from_arrays(arrays, names)

    return rows.mapInArrow(trimmed(run), schema.format(id=rows.schema["doc_id"].dataType.simpleString()))


def groups(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The groups of each text, in order: array of struct(a, b), both arrays of ids. No shuffle."""

    def row(ids, keys, columns, said, pairs):
        return [ids, pa.array([s.decode() for s in said])], ["doc_id", "said"]

    said = _mapped(docs, id_col, text_col, a_path, b_path, "doc_id {id}, said string", row)
    numbers = lambda g, k: F.split(F.split(g, r"\|")[k], ",").cast("array<int>")
    found = F.filter(F.split("said", ";"), lambda g: g != "")
    return said.select("doc_id", F.transform(found, lambda g: F.struct(numbers(g, 0).alias("a"), numbers(g, 1).alias("b"))).alias("groups"))


def pair_counts(links: DataFrame) -> DataFrame:
    """(a, b, n, best): how many links of the corpus hold a pair of ids, and whether no other pair of the B id has more."""
    counts = written(links.groupBy("a", "b").agg(F.sum("n").alias("n")))
    peak = counts.groupBy("b").agg(F.max("n").alias("peak"))
    return counts.join(peak.hint("merge"), "b").select("a", "b", "n", (F.col("n") == F.col("peak")).alias("best"))


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """One row per row of ``docs``: its id, COLUMNS, n_best and count_sum."""

    def row(ids, keys, columns, said, pairs):
        return [ids, keys, *(pa.array(x) for x in columns.values()), pairs], ["doc_id", "key", *columns, "links"]

    texts = written(_mapped(docs, id_col, text_col, a_path, b_path, f"doc_id {{id}}, key long, {COLUMNS}, links {LINKS}", row))
    counts = written(pair_counts(texts.select(F.inline("links"))))
    few = counts.count() <= broadcast_pairs
    counts = counts.withColumnRenamed("n", "count")
    each = texts.select("key", F.inline("links"))
    met = each.join(F.broadcast(counts) if few else counts.hint("merge"), ["a", "b"])
    sums = met.groupBy("key").agg(F.sum(F.when(F.col("best"), F.col("n").cast("long")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("count")).alias("count_sum"))
    names = [x.split()[0] for x in COLUMNS.split(", ")]
    return texts.select("doc_id", "key", *names).join(sums.hint("merge"), "key", "left").fillna(0, ["n_best", "count_sum"]).drop("key")
