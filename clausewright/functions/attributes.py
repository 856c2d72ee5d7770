"""Dynamic attributes: a VARIANT column of public fields, validated against the fixed schemas.

Functions that look at many fields decode the object once per row (``once``); those of a few fields, or of those of the row's own type, read them from the variant.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..dims import ATTRIBUTES, CANONICAL, ENUMS, LEGACY, UNIT_KEYWORDS
from .grounding import LIVE, NUMBER, Profile
from .text import contains_any, half_up, let


@dataclass(frozen=True)
class Decoded:
    """The types and the texts of an object's fields, two maps by name."""

    kinds: Column
    texts: Column


Fields = Column | Decoded


def once(a: Fields, body: Callable[[Decoded], Column]) -> Column:
    """``body`` of the fields of ``a``, which are decoded in one pass unless they are already."""
    if isinstance(a, Decoded):
        return body(a)
    whole = lambda kind: F.try_variant_get(a, F.lit("$"), kind)
    kinds = F.transform_values(whole("map<string,variant>"), lambda _, v: F.coalesce(F.schema_of_variant(v), F.lit("VOID")))
    return let(F.struct(kinds.alias("kinds"), whole("map<string,string>").alias("texts")), lambda m: body(Decoded(m["kinds"], m["texts"])))


def field(a: Fields, name: str, kind: str = "string") -> Column:
    if isinstance(a, Decoded):
        return a.texts[name] if kind == "string" else a.texts[name].try_cast(kind)
    return F.try_variant_get(a, F.lit(f"$.{name}"), kind)


def kind_of(a: Fields, name: str) -> Column:
    """Name of the field's type; null if it is missing, VOID if it is null."""
    if isinstance(a, Decoded):
        return a.kinds[name]
    return F.schema_of_variant(field(a, name, "variant"))


def is_kind(kind: Column, code: str) -> Column:
    """s string, n number (booleans count), l list, b boolean."""
    test = {"s": kind == "STRING", "n": kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|BOOLEAN)"), "l": kind.startswith("ARRAY"), "b": kind == "BOOLEAN"}[code]
    return F.coalesce(test, F.lit(False))


def present(a: Fields, name: str) -> Column:
    """The key is there, whatever its value."""
    return kind_of(a, name).isNotNull()


def has_value(a: Fields, name: str) -> Column:
    kind = kind_of(a, name)
    return F.coalesce(kind != "VOID", F.lit(False))


def truthy(a: Fields, name: str) -> Column:
    """Neither missing, null, empty, zero nor false."""
    if isinstance(a, Column):  # the type is looked up only where the text is one of those that may be empty, zero or false
        text = field(a, name)
        return F.when(text.isNull(), F.lit(False)).when(text.rlike(r"^(-?0|false$|\[\]$|\{\}$|$)"), _truthy(a, name)).otherwise(True)
    return _truthy(a, name)


def _truthy(a: Fields, name: str) -> Column:
    def of(x: Column) -> Column:
        kind, text = x["kind"], x["text"]
        empty = F.when(kind == "STRING", text == "").when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), field(a, name, "double") == 0).otherwise(text.isin("false", "[]", "{}"))
        return F.coalesce(kind != "VOID", F.lit(False)) & ~F.coalesce(empty, F.lit(False))

    return let(F.struct(kind_of(a, name).alias("kind"), field(a, name).alias("text")), of)


def missing_fields(a: Fields, rule_type: Column) -> Column:
    """Required fields that are missing, or there with a wrong type."""

    test = lambda f, code: let(kind_of(a, f), lambda kind: F.when(kind.isNull(), F.lit(f)).when(~is_kind(kind, code), F.lit(f"{f} (wrong type)")))
    out = F.array(F.concat(F.lit("Unknown rule_type: "), rule_type))
    for name, (required, _) in ATTRIBUTES.items():
        out = F.when(rule_type == name, F.filter(F.array(*[test(f, code) for f, code in required.items()]), lambda x: x.isNotNull())).otherwise(out)
    return out


def completeness(a: Fields, rule_type: Column, profile: Profile = LIVE) -> Column:
    out = F.lit(0.0)
    for name, (required, _) in ATTRIBUTES.items():
        right = sum((F.when(is_kind(kind_of(a, f), code), 1).otherwise(0) for f, code in required.items()), F.lit(0))
        share = F.lit(profile.completeness).cast("decimal(10,6)") * right.cast("decimal(10,0)") / F.lit(len(required)).cast("decimal(10,0)")
        out = F.when(rule_type == name, half_up(share, 3)).otherwise(out)
    return out


def canonical_errors(a: Fields, rule_type: Column) -> Column:
    """Required canonical fields that are missing, also under their older names; null for types without a canonical schema."""

    out = F.lit(None).cast("array<string>")
    for name, (required, _) in CANONICAL.items():
        tests = [F.when(~_canonical_there(a, f), F.lit(f)) for f in required]
        out = F.when(rule_type == name, F.filter(F.array(*tests), lambda x: x.isNotNull())).otherwise(out)
    return out


def _canonical_there(a: Fields, name: str) -> Column:
    """A value under the name, else under the first older name that is there."""
    older = F.lit(False)
    for x in reversed(LEGACY.get(name, ())):
        older = F.when(present(a, x), has_value(a, x)).otherwise(older)
    return F.when(has_value(a, name), F.lit(True)).otherwise(older)


def _canonical_text(a: Fields, name: str) -> Column:
    """Text of a canonical field if it is a string, older names included."""
    older = F.lit(None).cast("string")
    for x in reversed(LEGACY.get(name, ())):
        older = F.when(present(a, x), F.when(kind_of(a, x) == "STRING", field(a, x))).otherwise(older)
    return F.when(has_value(a, name), F.when(kind_of(a, name) == "STRING", field(a, name))).otherwise(older)


def canonical_warnings(a: Fields, rule_type: Column) -> Column:
    """Values of required fields outside their lists."""

    def of(a: Decoded) -> Column:
        out = F.array().cast("array<string>")
        for name, lists in ENUMS.items():
            tests = [F.when(~F.lower(_canonical_text(a, f)).isin(*allowed), F.concat(F.lit(f"{f}: '"), _canonical_text(a, f), F.lit("' not in enum"))) for f, allowed in lists.items() if f in CANONICAL[name][0]]
            out = F.when(rule_type == name, F.filter(F.array(*tests), lambda x: x.isNotNull())).otherwise(out)
        return out

    return once(a, of)


def compliance(a: Fields, rule_type: Column, profile: Profile = LIVE) -> Column:
    """Full for a valid canonical schema, half for one error, else 0."""
    return let(F.size(canonical_errors(a, rule_type)), lambda n: F.when(n == 0, profile.compliance[0]).when(n == 1, profile.compliance[1]).otherwise(0.0))


def quantification(a: Fields, description: Column) -> Column:
    def of(low: Column) -> Column:
        number = is_kind(kind_of(a, "threshold_value"), "n") | is_kind(kind_of(a, "threshold"), "n") | low.rlike(NUMBER)
        unit = truthy(a, "threshold_unit") | truthy(a, "unit") | truthy(a, "threshold_direction") | contains_any(low, UNIT_KEYWORDS)
        outcome = truthy(a, "exception_threshold") | truthy(a, "consequence") | truthy(a, "escalation")
        hundredths = F.when(number, 10).otherwise(0) + F.when(unit, 5).otherwise(0) + F.when(outcome, 5).otherwise(0)
        return hundredths / F.lit(100.0)

    return let(F.lower(description), of)


def canonical_normalized(a: Fields, rule_type: Column) -> Column:
    """Map of the canonical fields that have a value to their texts: older names resolved, listed values lower-cased, optional fields copied."""

    def of(a: Decoded) -> Column:
        out = F.lit(None).cast("map<string,string>")
        for name, (required, optional) in CANONICAL.items():
            pairs = []
            for f in required:
                value = _canonical_value(a, f)
                allowed = ENUMS.get(name, {}).get(f)
                if allowed:
                    value = F.when(F.lower(value).isin(*allowed), F.lower(value)).otherwise(value)
                pairs.append(F.struct(F.lit(f).alias("key"), value.alias("value")))
            pairs += [F.struct(F.lit(f).alias("key"), field(a, f).alias("value")) for f in optional]
            kept = F.filter(F.array(*pairs), lambda x: x["value"].isNotNull())
            out = F.when(rule_type == name, F.map_from_entries(kept)).otherwise(out)
        return out

    return once(a, of)


def _canonical_value(a: Fields, name: str) -> Column:
    older = F.lit(None).cast("string")
    for x in reversed(LEGACY.get(name, ())):
        older = F.when(present(a, x), field(a, x)).otherwise(older)
    return F.when(has_value(a, name), field(a, name)).otherwise(older)
