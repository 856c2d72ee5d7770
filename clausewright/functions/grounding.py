"""Grounding of a description in its source text, and related scores."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..dims import DOMAIN_KEYWORDS, NEGATIONS
from .text import count_contained, half_up, let

NUMBER = r"\d+\.?\d*\s*%?"


@dataclass(frozen=True)
class Profile:
    """Weights of the confidence features; LIVE is in use, OLDER is kept as an alternative."""

    jaccard: str
    stretch: str
    phrase_first: str
    phrase_each: str
    phrase_most: str
    completeness: str
    compliance: tuple[float, float]
    domain: tuple[float, float]


# Fixed values
LIVE = Profile("0.22", "1.5", "0.065", "0.0325", "0.13", "0.25", (0.12, 0.06), (0.03, 0.02))
OLDER = Profile("0.15", "1", "0", "0.05", "0.15", "0.20", (0.15, 0.08), (0.05, 0.03))


def _dec(x: str) -> Column:
    return F.lit(x).cast("decimal(10,6)")


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two sets as decimal; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0).cast("decimal(20,10)")).otherwise((both.cast("double") / F.greatest(union, F.lit(1))).cast("decimal(20,10)"))


def phrases(source: Column, target: Column, least: int = 3, most: int = 7) -> Column:
    """Maximal phrases of ``source`` (least to most words) that occur in ``target``, in order of first place.

    A phrase may start and end inside a word of the target, but the words between stand there whole; so only places whose next word is
    one of the target's are looked at, and from there a phrase grows word by word as long as the target holds it.
    """
    words = F.filter(F.split(F.lower(source), r"\s+"), lambda x: x != "")
    return let(F.struct(words.alias("words"), F.lower(target).alias("low")), lambda s: _maximal(s["words"], s["low"], least, most))


def _maximal(words: Column, low: Column, least: int, most: int) -> Column:
    text = lambda i, n: F.array_join(F.slice(words, i + 1, n), " ")

    def grown(i: Column) -> Column:
        """Words of the longest phrase from a place on that the target holds; least - 1 if there is none."""
        sizes = F.sequence(F.lit(least), F.least(F.lit(most), F.size(words) - i))
        return F.aggregate(sizes, F.lit(least - 1), lambda n, m: F.when((n == m - 1) & F.contains(low, text(i, m)), m).otherwise(n))

    places = F.when(F.size(words) >= least, F.sequence(F.lit(0), F.size(words) - least)).otherwise(F.array().cast("array<int>"))
    both = F.array_intersect(words, F.split(low, " "))
    likely = let(both, lambda shared: F.filter(places, lambda i: F.array_contains(shared, words[i + 1])))
    hits = F.filter(F.transform(likely, lambda i: F.struct(i.alias("i"), grown(i).alias("n"))), lambda h: h["n"] >= least)

    def longest(found: Column) -> Column:
        """Texts of the hits that do not lie in that of the place before."""
        before = lambda h, k: let(F.get(found, k - 1), lambda b: F.coalesce((b["i"] == h["i"] - 1) & (b["n"] > h["n"]), F.lit(False)))
        return F.array_distinct(F.transform(F.filter(found, lambda h, k: ~before(h, k)), lambda h: text(h["i"], h["n"])))

    return let(let(hits, longest), lambda kept: F.filter(kept, lambda p: ~F.exists(kept, lambda q: (F.length(q) > F.length(p)) & F.contains(q, p))))


def match_score(similarity: Column, n_phrases: Column, profile: Profile = LIVE) -> Column:
    """Grounding score in thousandths, from an unrounded similarity and the number of phrases."""
    by_words = _dec(profile.jaccard) * F.least(F.lit(1).cast("decimal(20,10)"), (similarity * _dec(profile.stretch)).cast("decimal(20,10)"))
    by_phrases = F.when(n_phrases > 0, F.least(_dec(profile.phrase_most), (_dec(profile.phrase_first) + _dec(profile.phrase_each) * n_phrases.cast("decimal(10,0)")).cast("decimal(10,6)"))).otherwise(_dec("0"))
    return half_up(by_words + by_phrases, 3)


def classify(score: Column, similarity: Column, n_phrases: Column) -> Column:
    """EXACT, PARAPHRASE or INFERENCE by the live cut-offs; similarity in thousandths."""
    exact = (score >= 0.15) | (similarity >= 0.25) | (n_phrases >= 2)
    near = (score >= 0.08) | (similarity >= 0.15) | (n_phrases >= 1)
    return F.when(exact, "EXACT").when(near, "PARAPHRASE").otherwise("INFERENCE")


def classify_older(score: Column) -> Column:
    return F.when(score >= 0.25, "EXACT").when(score >= 0.15, "PARAPHRASE").otherwise("INFERENCE")


def coherence(description: Column, grounded_in: Column) -> Column:
    """0 for a contradiction, 0.05 if numbers are on both sides and none agrees, else 0.10."""
    a, b = F.lower(description), F.lower(grounded_in)
    clash = F.lit(False)
    for no, yes in NEGATIONS:
        for x, y in ((a, b), (b, a)):
            clash = clash | (F.contains(x, F.lit(no)) & F.contains(y, F.lit(yes)) & ~F.contains(y, F.lit(no)))
    na, nb = (F.regexp_extract_all(x, F.lit(NUMBER), F.lit(0)) for x in (a, b))
    differ = (F.size(na) > 0) & (F.size(nb) > 0) & ~F.arrays_overlap(na, nb)
    return F.when(clash, 0.0).when(differ, 0.05).otherwise(0.10)


def domain_signals(description: Column, grounded_in: Column, profile: Profile = LIVE) -> Column:
    n = count_contained(F.lower(F.concat_ws(" ", description, grounded_in)), DOMAIN_KEYWORDS)
    return F.when(n >= 3, profile.domain[0]).when(n >= 1, profile.domain[1]).otherwise(0.0)
