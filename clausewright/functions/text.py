"""Text functions: pure Column expressions, all inside the JVM."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dims import PAGE_PATTERN, STOP_WORDS


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row, however often and in whatever lambdas it is read."""
    return F.transform(F.array(value), body)[0]


def lit_array(values: Iterable[str]) -> Column:
    values = list(values)
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def normalize_text(text: Column) -> Column:
    """Line ends to \\n, trailing blanks of lines and runs of blank lines shortened, outer line breaks cut."""
    out = F.regexp_replace(text, "\r\n?", "\n")
    out = F.regexp_replace(out, "[ \t]+(\n|$)", "$1")
    out = F.regexp_replace(out, "\n{3,}", "\n\n")
    return F.regexp_replace(out, "^\n+|\n+$", "")


def clean_paragraph(text: Column) -> Column:
    """Normalised text, empty for page counters."""
    out = normalize_text(text)
    return F.when(out.rlike(PAGE_PATTERN), "").otherwise(out)


def contains_any(text: Column, words: Sequence[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def starts_with_any(text: Column, words: Sequence[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.startswith(w)
    return out


def count_contained(text: Column, words: Sequence[str]) -> Column:
    """How many of the words occur as substrings."""
    return sum((F.when(F.contains(text, F.lit(w)), 1).otherwise(0) for w in words), F.lit(0))


def first_match(text: Column, table: Sequence[tuple[Sequence[str], str]]) -> Column:
    """The value of the first row of which a word occurs; a row without words always matches."""
    out: Column | None = None
    for words, value in reversed(table):
        out = F.lit(value) if not words else F.when(contains_any(text, words), F.lit(value)).otherwise(F.lit(None) if out is None else out)
    return out


def score_tokens(text: Column) -> Column:
    """Distinct ASCII alphanumeric words of the lower-cased text."""
    whole = r"(?<![\p{L}\p{M}\p{N}_])[a-z0-9]++(?![\p{L}\p{M}\p{N}_])"
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(whole), F.lit(0)))


def content_tokens(text: Column) -> Column:
    """Distinct words of the lower-cased text without stop words."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{M}\p{N}_]+"), F.lit(0))
    return F.array_except(F.array_distinct(runs), lit_array(STOP_WORDS))


def blank_tokens(text: Column) -> Column:
    """Distinct words of the lower-cased text, split at white space."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"\s+"), lambda x: x != ""))


def half_up(x: Column, digits: int) -> Column:
    """Rounds half up through decimals, so that equal inputs round alike in any engine."""
    return F.round(x.cast("decimal(20,10)"), digits).cast("double")


def fixed(x: Column, digits: int) -> Column:
    """Text with a fixed number of decimals, rounded half up."""
    return F.round(x.cast("decimal(20,10)"), digits).cast(f"decimal(20,{digits})").cast("string")


def settled(df: DataFrame) -> DataFrame:
    """The same rows through a generator, below which no filter or projection moves.

    Columns that many later expressions read are computed once; without it a
    filter on one of them would carry copies of all that it is made of down to
    the scan.
    """
    return df.select(F.explode(F.array(F.struct("*"))).alias("_row")).select("_row.*")
