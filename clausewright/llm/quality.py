"""Quality classifier: naive Bayes features into a linear hinge-loss model.

Features are indicators of the byte n-grams and of the words of a text, hashed
to ``1 << BITS`` places. Their class counts are summed over all labelled rows;
the log ratio of the smoothed class counts scales each indicator. The linear
model on the scaled indicators is fitted by dual coordinate descent, on the
driver, on a bounded sample: the ``MAX_TRAIN`` training rows with the smallest
hash of their id, half of them of each class where there are enough (one row of
each id, whatever the repeats). A logistic curve through held-back margins, in which
the classes weigh as their numbers of labelled rows, makes scores of margins: a
score is about the share of rows like this one that are labelled 1.

Scoring is one narrow pass over whole texts; the weights are one array of fixed size.

Defined cases: a null or empty text has no features and scores by the bias
alone; rows whose label is null, and labels of unknown documents, do not
train; repeated labels of a row, and rows of one labelled id, count each in the class
counts; ids may be of any type; a text of any length is scored whole; without rows of both
classes every score is 0.5; an empty table gives no rows; extra columns are left
alone, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import named
from .text import BYTE_HASH, Slice, U, cut, mix, trimmed

BITS = 18
MAX_TRAIN = 6000
BYTE_GRAMS = (1, 2, 3)
#: Labels (16 bytes each) are broadcast up to this many rows; beyond, texts and labels are dealt out by id.
BROADCAST_LABELS = 1_000_000


def features(s: Slice) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of each row, row by row, and their offsets."""
    doc = np.repeat(np.arange(s.n), np.diff(s.off)).astype(np.uint64)
    row, feature = [], []
    for n in BYTE_GRAMS:
        m = len(s.buf) - n + 1
        if m <= 0:
            continue
        h = np.full(m, U(n))
        for j in range(n):
            h = h * U(0x9FB21C651E98DF25) + BYTE_HASH[s.buf[j : j + m]]
        ok = doc[:m] == doc[n - 1 :]
        row.append(doc[:m][ok])
        feature.append(mix(h[ok]) >> U(64 - BITS))
    row.append(s.doc.astype(np.uint64))
    feature.append(mix(s.word_hashes() ^ U(0x5851F42D4C957F2D)) >> U(64 - BITS))
    both = (np.concatenate(row) << U(BITS)) | np.concatenate(feature)
    if s.n << BITS < 1 << 32:
        both = both.astype(np.uint32)
    both.sort()
    both = both[np.append(True, both[1:] != both[:-1])] if len(both) else both
    off = np.searchsorted(both, (np.arange(s.n + 1, dtype=np.uint64) << U(BITS)).astype(both.dtype) if s.n << BITS < 1 << 32 else np.arange(s.n + 1, dtype=np.uint64) << U(BITS))
    return (both & ((1 << BITS) - 1)).astype(np.int64), off


def hinge(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, c: float = 1.0, epochs: int = 12, seed: int = 0) -> tuple[np.ndarray, float]:
    """Weights of min |w|^2 / 2 + c sum of hinge losses, by dual coordinate descent; x is the unit vector of scaled indicators."""
    w, bias, a = np.zeros(len(scale)), 0.0, np.zeros(len(rows))
    norm = np.array([np.sqrt(np.square(scale[r]).sum()) or 1.0 for r in rows])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            r = rows[i]
            x = scale[r] / norm[i]
            gradient = y[i] * (w[r] @ x + bias) - 1
            new = min(max(a[i] - gradient / 2.0, 0.0), c)  # |x|^2 is 1, and 1 for the bias
            if new != a[i]:
                step = (new - a[i]) * y[i]
                w[r] += step * x
                bias += step
                moved += abs(new - a[i])
                a[i] = new
        if moved < 1e-3 * len(rows):
            break
    return w, bias


def margins(rows: Iterator[np.ndarray], w: np.ndarray, scale: np.ndarray, bias: float) -> np.ndarray:
    return np.array([w[r] @ scale[r] / (np.sqrt(np.square(scale[r]).sum()) or 1.0) + bias for r in rows])


def curve(m: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve through margins; classes weigh as their numbers n of rows."""
    share = n / n.sum()
    weight = np.where(y > 0, share[1] / max((y > 0).sum(), 1), share[0] / max((y < 0).sum(), 1))
    t = (y > 0) * 0.98 + 0.01
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        e, v = weight * (p - t), weight * p * (1 - p) + 1e-9
        g = np.array([e @ m, e.sum()])
        h = np.array([[v @ (m * m) + 1e-4, v @ m], [v @ m, v.sum() + 1e-4]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return max(float(a), 1e-3), float(b)


class Model:
    def __init__(self, weight: np.ndarray, scale: np.ndarray, bias: float, slope: float, offset: float):
        self.product, self.square = (weight * scale), np.square(scale)
        self.bias, self.slope, self.offset = bias, slope, offset

    def score(self, s: Slice) -> np.ndarray:
        f, off = features(s)
        row = np.repeat(np.arange(s.n), np.diff(off))
        dot = np.bincount(row, weights=self.product[f], minlength=s.n)
        norm = np.sqrt(np.bincount(row, weights=self.square[f], minlength=s.n))
        m = dot / np.where(norm > 0, norm, 1.0) + self.bias
        return 1 / (1 + np.exp(-np.clip(self.slope * m + self.offset, -30, 30)))


def train(labelled: DataFrame, sample: DataFrame, smooth: float = 1.0) -> Model:
    """Fits on rows (text, label), label 0 or 1: class counts from ``labelled``, the linear model on ``sample``, which must be bounded."""
    labelled, sample = (x.select("text", F.col("label").cast("int").alias("label")).where("label IN (0, 1)") for x in (labelled, sample))

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros((2, 1 << BITS), np.int64), np.zeros(2, np.int64)
        for batch in batches:
            label = batch.column(1).to_numpy(zero_copy_only=False)
            for a, b, s in cut(batch.column(0)):
                f, off = features(s)
                y = np.repeat(label[a:b], np.diff(off))
                for k in (0, 1):
                    total[k] += np.bincount(f[y == k], minlength=1 << BITS)
                    rows[k] += int((label[a:b] == k).sum())
        at = np.flatnonzero(total.sum(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[0][at], rows[0])), pa.array(np.append(total[1][at], rows[1]))], ["feature", "c0", "c1"])

    sums = labelled.select("text", "label").mapInArrow(trimmed(counts), "feature long, c0 long, c1 long").groupBy("feature").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))
    got = sums.toPandas()  # at most one row per place
    n = got[got["feature"] == -1][["c0", "c1"]].to_numpy().reshape(-1)
    blank = Model(np.zeros(1 << BITS), np.zeros(1 << BITS), 0.0, 1.0, 0.0)
    if len(n) < 2 or not n.all():
        return blank
    got = got[got["feature"] >= 0]
    count = np.full((2, 1 << BITS), smooth)
    for k in (0, 1):
        count[k][got["feature"].to_numpy()] += got[f"c{k}"].to_numpy()
    ratio = np.log(count[1] / (n[1] + 2 * smooth)) - np.log(count[0] / (n[0] + 2 * smooth))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, s in cut(batch.column(0)):
                f, off = features(s)
                data = [f[x:y].astype("<u4").tobytes() for x, y in zip(off[:-1], off[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(data, pa.binary()), batch.column(1).slice(a, b - a)], ["f", "label"])

    rows, y = [], []
    for r in sample.mapInArrow(trimmed(pick), "f binary, label int").toLocalIterator():
        rows.append(np.frombuffer(bytes(r["f"]), "<u4").astype(np.int64))
        y.append(1.0 if r["label"] else -1.0)
    order = sorted(range(len(y)), key=lambda i: (y[i], rows[i].tobytes()))  # whatever order they came in
    rows, y = [rows[i] for i in order], [y[i] for i in order]
    y = np.array(y)
    held = np.arange(len(y)) % 5 == 0
    w, bias = hinge([r for r, h in zip(rows, held) if not h], y[~held], ratio)
    slope, offset = curve(margins((r for r, h in zip(rows, held) if h), w, ratio, bias), y[held], n)
    w, bias = hinge(rows, y, ratio)
    return Model(w, ratio, bias, slope, offset)


def split(docs: DataFrame, labels: DataFrame, folds: int = 5, max_train: int = MAX_TRAIN, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> tuple[DataFrame, DataFrame]:
    """The labelled rows whose crc32 of the id, as text, is no multiple of ``folds``; and a bounded sample of them."""
    known = named(labels, r_id=id_col, label=label_col).withColumn("label", F.col("label").cast("int")).where("label IN (0, 1) AND r_id IS NOT NULL").where(F.crc32(F.col("r_id").cast("string")) % folds != 0)
    texts = named(docs, r_id=id_col, text=text_col)
    few = [known.where(F.col("label") == k).distinct().orderBy(F.xxhash64("r_id"), "r_id").limit(max_train // 2) for k in (0, 1)]
    # one row of each id and label: at most max_train, however often an id repeats
    sample = texts.join(F.broadcast(few[0].unionByName(few[1])), "r_id").groupBy("r_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    few_labels = known.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS
    return texts.join(F.broadcast(known) if few_labels else known.hint("merge"), "r_id"), sample


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """One row per row: doc_id, score, predicted."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # two arrays of 1 << BITS numbers
    docs = named(docs, doc_id=id_col, text=text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, s in cut(batch.column(1)):
                p = sent.value.score(s)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.mapInArrow(trimmed(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, predicted int")
