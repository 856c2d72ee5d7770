"""Fill-in-middle transformation: texts cut in three at random code points and put in another order.

A Split pre-tokenizer of the tokenizers library isolates single code points; the
length of its offset array is the number of code points of a text, and the
offset at a rank is where a slice ends. Nothing is trained. A text goes through it in segments of
``SEGMENT`` code points, so only one segment's offsets exist at a time. Ranks and
form come from the digest of the row's id, so reruns agree, and no row depends on another: no shuffle, no skew.

Defined cases: a null or empty text has no code points and is plain; a text that holds a
mark is plain; equal ranks give an empty middle; a null id is hashed as the empty string; ids may be of any
type, by their text, and rows of one id are cut by the same four numbers; a text of any length is cut
whole; an empty table gives no rows; extra columns, whatever their names, are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex
from tokenizers.pre_tokenizers import Split

from .session import named
from .text import flat, slices, trimmed

PREFIX, SUFFIX, MIDDLE = MARKS = ("<P>", "<S>", "<M>")
#: Code points that are matched at once.
SEGMENT = 256
OUT = "n long, form string, prefix_chars long, middle_chars long, output string"
#: Matches every second code point; isolated, those between are pieces of their own too, at half the matches.
_ONE = r"[\s\S]\K[\s\S]"


class Cuts:
    """The isolated code points of a text, counted segment by segment."""

    def __init__(self, text: str, split: Split):
        self.text, self.split = text, split
        self.counts = [len(split.pre_tokenize_str(text[a : a + SEGMENT])) for a in range(0, len(text), SEGMENT)]
        self.n = sum(self.counts)

    def offset(self, rank: int) -> int:
        """Where the code point of this rank (from 0) starts; the end of the text for rank n."""
        for k, count in enumerate(self.counts):
            if rank < count:
                return k * SEGMENT + self.split.pre_tokenize_str(self.text[k * SEGMENT : (k + 1) * SEGMENT])[rank][1][0]
            rank -= count
        return len(self.text)


def numbers(id_col: Column, seed: int = 1) -> list[Column]:
    """The first four 8-digit groups of the sha256 of ``seed:id``, as unsigned integers."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]


def rearranged(text: str, split: Split, h: tuple[int, int, int, int], changed: int, suffix_first: int) -> tuple:
    """The columns of OUT for one text."""
    cuts = Cuts(text, split)
    if not text or any(m in text for m in MARKS) or h[2] % 100 >= changed:
        return cuts.n, "plain", None, None, text
    a, b = sorted((h[0] % (cuts.n + 1), h[1] % (cuts.n + 1)))
    i, j = cuts.offset(a), cuts.offset(b)
    if h[3] % 100 < suffix_first:
        return cuts.n, "spm", a, b - a, f"{SUFFIX}{text[j:]}{PREFIX}{text[:i]}{MIDDLE}{text[i:j]}"
    return cuts.n, "psm", a, b - a, f"{PREFIX}{text[:i]}{SUFFIX}{text[j:]}{MIDDLE}{text[i:j]}"


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, changed: int = 90, suffix_first: int = 20) -> DataFrame:
    """One row per row of ``docs``: its id and the columns of OUT.

    changed: percentage of texts that are rearranged; suffix_first: percentage of those whose suffix comes first (spm).
    """
    rows = named(docs, doc_id=id_col, text=text_col)
    rows = rows.select("doc_id", "text", *numbers(F.col("doc_id"), seed))
    names = ["doc_id", *(x.split()[0] for x in OUT.split(", "))]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = Split(Regex(_ONE), "isolated")
        for batch in batches:
            _, off = flat(batch.column(1))
            for a, b in slices(off):
                part = batch.slice(a, b - a)
                hashes = zip(*(part.column(k).to_pylist() for k in range(2, 6)))
                done = [rearranged(text or "", split, h, changed, suffix_first) for text, h in zip(part.column(1).to_pylist(), hashes)]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, k) for x, k in zip(zip(*done), kinds))], names)

    return rows.mapInArrow(trimmed(run), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {OUT}")


def restored(output: Column, form: Column) -> Column:
    """The text that was cut, from its output and form alone: marks stand nowhere in the parts, so they separate them."""
    parts = F.split(output, "|".join(MARKS), -1)
    return F.when(form == "psm", F.concat(parts[1], parts[3], parts[2])).when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(output)
