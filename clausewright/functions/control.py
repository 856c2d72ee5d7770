"""Control metadata inferred from type, description and attributes."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import dims
from . import attributes as at
from .text import contains_any, count_contained, let, lit_array


def by_type(rule_type: Column, table: Mapping[str, object], default: Column, make=F.lit) -> Column:
    out = default
    for name, value in table.items():
        out = F.when(rule_type == name, make(value)).otherwise(out)
    return out


def applies_to(a: Column) -> Column:
    return F.when(at.present(a, "applies_to"), F.coalesce(at.field(a, "applies_to"), F.lit("None"))).otherwise("relevant records")


def single_words(text: Column) -> Column:
    """Doubled words made single."""
    return F.regexp_replace(text, r"(?iU)\b(\w++)\s+\1\b", "$1")


def objective(a: at.Fields, rule_type: Column) -> Column:
    template = by_type(rule_type, dims.OBJECTIVES, F.lit(dims.DEFAULT_OBJECTIVE))
    return single_words(F.replace(template, F.lit("{applies_to}"), applies_to(a)))


def risks(rule_type: Column, description: Column) -> Column:
    base = by_type(rule_type, dims.RISKS, lit_array([dims.REGULATORY]), lit_array)
    told = lambda low: F.array(F.when(contains_any(low, dims.AVAILABILITY_WORDS), dims.AVAILABILITY), F.when(contains_any(low, dims.VENDOR_WORDS), dims.VENDOR))
    return F.slice(F.array_union(base, F.filter(let(F.lower(description), told), lambda x: x.isNotNull())), 1, 3)


def control_type(rule_type: Column, description: Column) -> Column:
    def of(low: Column) -> Column:
        out = by_type(rule_type, dims.TYPE_CONTROL, F.lit("general"))
        for words, name in reversed(dims.CONTROL_WORDS):
            out = F.when(contains_any(low, words), F.lit(name)).otherwise(out)
        return out

    return let(F.lower(description), of)


def measurement_type(a: at.Fields, rule_type: Column) -> Column:
    return (
        F.when(at.truthy(a, "threshold_value") | at.truthy(a, "metric"), "quantitative")
        .when(at.truthy(a, "timeline_value"), "timeline")
        .when(rule_type.isin("documentation_requirement", "ownership_category"), "qualitative")
        .otherwise("quantitative")
    )


def _first_of(a: at.Fields, *names: str) -> Column:
    out = F.lit("")
    for name in reversed(names):
        out = F.when(at.present(a, name), F.coalesce(at.field(a, name), F.lit("None"))).otherwise(out)
    return out


def test_procedure(a: at.Fields, rule_type: Column, description: Column, control: Column | None = None, measure: Column | None = None) -> Column:
    """Template by control and measurement type, else the first of the control type, else the default. control, measure: columns that hold them, if there are some."""
    if control is None or measure is None:
        kinds = F.struct(control_type(rule_type, description).alias("control"), measurement_type(a, rule_type).alias("measure"))
        out = let(kinds, lambda x: _template(x["control"], x["measure"]))
    else:
        out = _template(control, measure)
    for key, value in (("applies_to", applies_to(a)), ("threshold", _first_of(a, "threshold_value", "timeline_value")), ("unit", _first_of(a, "threshold_unit", "timeline_unit"))):
        out = F.replace(out, F.lit("{" + key + "}"), value)
    return out


def _template(control: Column, measure: Column) -> Column:
    out, seen = F.lit(dims.DEFAULT_PROCEDURE), set()
    for (c, _), text in reversed(dims.TEST_PROCEDURES.items()):
        first = next(t for (x, _), t in dims.TEST_PROCEDURES.items() if x == c)
        if c not in seen:
            out = F.when(control == c, F.lit(first)).otherwise(out)
            seen.add(c)
    for (c, m), text in dims.TEST_PROCEDURES.items():
        out = F.when((control == c) & (measure == m), F.lit(text)).otherwise(out)
    return out


def owner(a: at.Fields, rule_type: Column) -> Column:
    return F.when(at.truthy(a, "responsible_party"), at.field(a, "responsible_party")).otherwise(by_type(rule_type, dims.OWNERS, F.lit(dims.DEFAULT_OWNER)))


def automation(description: Column) -> Column:
    counts = let(F.lower(description), lambda low: F.struct(count_contained(low, dims.AUTO_WORDS).alias("auto"), count_contained(low, dims.MANUAL_WORDS).alias("manual")))
    return let(counts, lambda n: F.when(n["auto"] > n["manual"], "automated").when(n["manual"] > n["auto"], "manual").otherwise("hybrid"))


def evidence(rule_type: Column) -> Column:
    return by_type(rule_type, dims.EVIDENCE, lit_array(dims.DEFAULT_EVIDENCE), lit_array)


def _system_hits(description: Column) -> Column:
    word = lambda low, words: F.coalesce(*[F.when(F.contains(low, F.lit(w)), F.lit(w)) for w in words])
    hits = let(F.lower(description), lambda low: F.array(*[F.struct(F.lit(s).alias("system"), word(low, words).alias("word")) for s, words in dims.SYSTEMS.items()]))
    return F.filter(hits, lambda x: x["word"].isNotNull())


def systems(description: Column) -> Column:
    """Struct of systems (at most three), source and all matched keywords."""
    return let(_system_hits(description), _systems)


def _systems(hits: Column) -> Column:
    some = F.size(hits) > 0
    return F.struct(
        F.when(some, F.slice(F.transform(hits, lambda x: x["system"]), 1, 3)).otherwise(lit_array([dims.DEFAULT_SYSTEM])).alias("systems"),
        F.when(some, "keyword_inferred").otherwise("default_template").alias("source"),
        F.transform(hits, lambda x: x["word"]).alias("keywords"),
    )


def safe_number(a: at.Fields, name: str, default: float) -> Column:
    """A number or a numeric string, per cent sign allowed; the default otherwise."""
    kind = at.kind_of(a, name)
    text = F.trim(F.replace(at.field(a, name), F.lit("%"), F.lit("")))
    value = F.when(at.is_kind(kind, "n") & (kind != "BOOLEAN"), at.field(a, name, "double")).when(kind == "BOOLEAN", at.field(a, name, "boolean").cast("double")).when(kind == "STRING", F.coalesce(text.try_cast("double"), F.lit(default)))
    return F.coalesce(value, F.lit(default))


def exception_tiers(a: at.Fields, rule_type: Column) -> Column:
    """Map of tier to (condition, action, sla_remediation)."""
    unit = F.when(at.present(a, "threshold_unit"), at.field(a, "threshold_unit")).otherwise("percent")

    def tiers(t: Column) -> Column:
        text = {"a": (t - 1).cast("string"), "b": (t - 0.5).cast("string"), "c": t.cast("string")}
        pairs = []
        for tier, condition, action, sla in dims.TIERS:
            c = F.lit(condition)
            for key, value in text.items():
                if "{" + key + "}" in condition:
                    c = F.replace(c, F.lit("{" + key + "}"), value)
            pairs += [F.lit(tier), F.struct(c.alias("condition"), F.lit(action).alias("action"), F.lit(sla).alias("sla_remediation"))]
        return F.create_map(*pairs)

    n = safe_number(a, "timeline_value", 30.0).cast("long")
    breach = F.struct(
        F.concat(F.lit("Update not completed within "), n.cast("string"), F.lit(" "), unit).alias("condition"),
        F.lit(dims.BREACH_ACTION).alias("action"),
        F.concat(F.floor(n / 2).cast("string"), F.lit(" "), unit).alias("sla_remediation"),
    )
    kind = "map<string,struct<condition:string,action:string,sla_remediation:string>>"
    return F.when((rule_type == "data_quality_threshold") & unit.isin("percent", "%"), let(safe_number(a, "threshold_value", 99.0), tiers).cast(kind)).when(rule_type == "update_timeline", F.create_map(F.lit("breach"), breach).cast(kind)).otherwise(F.create_map().cast(kind))


def told(rule_type: Column, description: Column) -> Column:
    """What type and description say by themselves, as one struct."""
    return F.struct(risks(rule_type, description).alias("risks"), control_type(rule_type, description).alias("control"), automation(description).alias("automated"), systems(description).alias("systems"))


def metadata(a: at.Fields, rule_type: Column, description: Column, known: Column | None = None, measure: Column | None = None) -> Column:
    """All of it as one struct. known, measure: columns that hold ``told`` and ``measurement_type``, if there are some."""
    s = systems(description) if known is None else known["systems"]
    return F.struct(
        objective(a, rule_type).alias("control_objective"),
        (risks(rule_type, description) if known is None else known["risks"]).alias("risk_addressed"),
        test_procedure(a, rule_type, description, None if known is None else known["control"], measure).alias("test_procedure"),
        owner(a, rule_type).alias("control_owner"),
        (automation(description) if known is None else known["automated"]).alias("automated"),
        evidence(rule_type).alias("evidence_type"),
        F.lit("default_template").alias("evidence_type_source"),
        s["systems"].alias("system_mapping"),
        s["source"].alias("system_mapping_source"),
        s["keywords"].alias("system_mapping_keywords"),
        exception_tiers(a, rule_type).alias("exception_threshold"),
    )


def is_complete(m: str) -> Column:
    texts = [F.coalesce(F.col(f"{m}.{x}"), F.lit("")) != "" for x in ("control_objective", "test_procedure", "control_owner", "automated")]
    return texts[0] & texts[1] & texts[2] & texts[3] & (F.size(f"{m}.risk_addressed") > 0) & (F.size(f"{m}.evidence_type") > 0)
