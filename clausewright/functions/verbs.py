"""Vague verbs and their replacements."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..dims import FREQUENCIES, METRICS, VERB_CONTEXTS, VERBS
from .text import count_contained, let

RESULT_TYPE = "replaced:string,replacements:array<struct<original_verb:string,replacement:string,context:string>>,has_vague_verbs:boolean"


def context(text: Column) -> Column:
    """The context with most of its keywords in the text, the first on ties; default if none."""
    score = lambda low: [F.struct(count_contained(low, words).alias("n"), F.lit(-i).alias("i"), F.lit(name).alias("name")) for i, (name, words) in enumerate(VERB_CONTEXTS.items())]
    best = let(F.lower(text), lambda low: F.array_max(F.array(*score(low))))
    return let(best, lambda b: F.when(b["n"] > 0, b["name"]).otherwise("default"))


def base_verb_count(text: Column) -> Column:
    """Occurrences of the eight verbs in their base form."""
    return F.regexp_count(F.lower(text), F.lit(r"\b(" + "|".join(VERBS) + r")\b"))


def has_base_verb(text: Column) -> Column:
    return base_verb_count(text) > 0


def template_values(text: Column) -> dict[str, Column]:
    low = F.lower(text)
    share = F.regexp_extract(text, r"(\d+\.?\d*)\s*%", 1)
    freq = F.coalesce(*[F.when(F.contains(low, F.lit(x)), F.lit(x)) for x in FREQUENCIES], F.lit("quarterly"))
    metric = F.coalesce(*[F.when(F.contains(low, F.lit(x)), F.lit(x)) for x in METRICS], F.lit(""))
    return {"n": F.lit("100"), "frequency": freq, "threshold": F.when(share != "", F.concat(share, F.lit("%"))).otherwise(""), "metric": metric}


def _forms(verb: str) -> str:
    """A form of the verb as a word of its own, in any case; word characters are letters, digits and _ of any script."""
    return rf"(?<![\p{{L}}\p{{N}}_])(?:{verb}s?|{verb}ing|{verb}ed)(?![\p{{L}}\p{{N}}_])"


def _template(text: str, value: Callable[[str], Column]) -> Column:
    parts = re.split(r"\{(\w+)\}", text)
    return F.concat(*[value(x) if i % 2 else F.lit(x) for i, x in enumerate(parts) if x])


def _replaced(verb: str, state: Column, row: Column) -> Column:
    """Replaces the forms of one verb, from left to right: each hit is put in place of the first form that is left."""
    value = lambda name: F.coalesce(row["scalars"][name], row[name])
    choices = VERBS[verb]
    new = F.coalesce(*[F.when(row["found"] == name, _template(x, value)) for name, x in choices.items() if name != "default"], _template(choices["default"], value))
    # the bare stem is a cheaper search than its forms, and most texts lack it
    hits = F.when(state["text"].rlike("(?iu)" + verb), F.regexp_extract_all(state["text"], F.lit("(?iu)" + _forms(verb)), F.lit(0))).otherwise(F.array().cast("array<string>"))

    def one(s: Column, hit: Column) -> Column:
        cased = F.when(hit.rlike(r"^\p{Lu}"), F.concat(F.upper(F.substring(new, 1, 1)), F.lower(F.substring(new, 2, 1 << 30)))).otherwise(new)
        quoted = F.concat(F.lit("$1"), F.regexp_replace(cased, r"([\\$])", r"\\$1"))
        text = F.regexp_replace(s["text"], F.lit(r"(?isu)\A(.*?)" + _forms(verb)), quoted)
        return F.struct(text.alias("text"), F.array_append(s["done"], F.struct(hit.alias("original_verb"), cased.alias("replacement"), row["found"].alias("context"))).alias("done"))

    return F.aggregate(hits, state, one)


def _step(verb: str, state: Column, row: Column) -> Column:
    return F.transform(F.array(state), lambda s: _replaced(verb, s, row))[0]


def replace_vague(text: Column, scalars: Column | None = None) -> Column:
    """Struct of RESULT_TYPE. scalars: map of attribute texts that override what the text says.

    Verb after verb, a later verb sees what an earlier one put in: an ordered
    fold in built-in expressions. Each step is bound by a one-element array, so
    it is evaluated once. Rows without a form of any verb take no step.
    """
    nothing = F.array().cast("array<struct<original_verb:string,replacement:string,context:string>>")
    scalars = F.create_map().cast("map<string,string>") if scalars is None else F.coalesce(scalars, F.create_map().cast("map<string,string>"))
    values = [c.alias(k) for k, c in template_values(text).items()]
    rows = F.array(F.struct(text.alias("text"), context(text).alias("found"), scalars.alias("scalars"), *values))

    def fold(row: Column) -> Column:
        state = F.struct(row["text"].alias("text"), nothing.alias("done"))
        for verb in VERBS:
            state = _step(verb, state, row)
        return state

    done = F.transform(rows, fold)
    out = F.transform(done, lambda s: F.struct(s["text"].alias("replaced"), s["done"].alias("replacements"), (F.size(s["done"]) > 0).alias("has_vague_verbs")))[0]
    none = F.struct(text.alias("replaced"), nothing.alias("replacements"), F.lit(False).alias("has_vague_verbs"))
    some = text.rlike("(?iu)" + "|".join(VERBS))
    return F.when(some, out).otherwise(none).cast(f"struct<{RESULT_TYPE}>")
