"""Repair of attributes that failed validation, by keyword rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dims
from . import attributes as at
from .text import first_match, let, lit_array, settled

#: Fields repaired by the first row of which a word occurs in the description.
BY_WORDS = {
    "applies_to": dims.APPLIES_TO,
    "threshold_direction": dims.DIRECTION,
    "threshold_unit": dims.UNIT,
    "metric": dims.METRIC,
    "ownership_type": dims.OWNERSHIP,
    "applies_when": dims.APPLIES_WHEN,
    "control_mechanism": dims.MECHANISM,
    "control_type": dims.CONTROL_TYPE,
}


def number_in(text: Column) -> Column:
    """The first number, as its digits; null if there is none."""
    x = F.regexp_extract(F.coalesce(text, F.lit("")), r"\d+\.?\d*", 0)
    return F.when(x != "", F.regexp_replace(x, r"\.$", ".0"))


def repaired_value(name: str, description: Column, timeline: Column) -> Column:
    """JSON of the repaired value of a missing field, null where it cannot be repaired; timeline is the text of that attribute."""
    return _repaired(name, description, F.lower(description), timeline)


def _repaired(name: str, description: Column, low: Column, timeline: Column) -> Column:
    if name in BY_WORDS:
        return _quoted(first_match(low, BY_WORDS[name]))
    if name == "requirement":
        return _quoted(description)
    if name == "required_data_elements":
        return F.lit("[]")
    if name == "threshold_value":
        return F.coalesce(number_in(timeline), number_in(low))
    return F.lit(None).cast("string")


def _quoted(x: Column) -> Column:
    """A JSON string."""
    return F.regexp_extract(F.to_json(F.array(x)), r"(?s)^\[(.*)\]$", 1)


def applicable_fields(description: Column) -> Column:
    """Distinct fields whose patterns occur, in order of the patterns; null if none."""
    found = lambda low: F.array(*[F.when(F.contains(low, F.lit(p)), F.lit(f)) for p, f in dims.FIELD_PATTERNS.items()])
    out = F.array_distinct(F.array_compact(let(F.lower(description), found)))
    return let(out, lambda x: F.when(F.size(x) > 0, x))


def data_source(description: Column, rule_type: Column) -> Column:
    known = lambda low: F.coalesce(*[F.when(F.contains(low, F.lit(p)), F.lit(s)) for p, s in dims.SOURCE_PATTERNS.items()])
    by_type = [F.when(rule_type == t, F.lit(s)) for t, s in dims.TYPE_SOURCE.items()]
    return F.coalesce(let(F.lower(description), known), *by_type)


def with_repair(df: DataFrame) -> DataFrame:
    """Validates a (rule_type, rule_description, a), repairs what failed, validates again.

    Adds missing_before, repaired_fields, missing_fields, schema_status (valid,
    repaired, rejected) and replaces a. Rows that were valid are left alone.
    """
    kind, d, a = F.col("rule_type"), F.col("rule_description"), F.col("a")
    df = settled(df.withColumn("missing_before", at.missing_fields(a, kind)))
    bad = F.size("missing_before") > 0
    inferred = F.struct(F.when(~at.has_value(a, "applicable_fields"), applicable_fields(d)).alias("fields"), F.when(~at.has_value(a, "data_source"), data_source(d, kind)).alias("source"))
    df = settled(df.withColumns({"_inferred": F.when(bad, inferred), "_timeline": F.when(bad, at.field(a, "timeline")), "_low": F.when(bad, F.lower(d))}))
    names = list(dict.fromkeys(f for required, _ in dims.ATTRIBUTES.values() for f in required))
    pair = lambda name, value: F.struct(F.lit(name).alias("key"), value.alias("value"))
    fixes = F.array(*[F.when(F.array_contains("missing_before", name), pair(name, _repaired(name, d, F.col("_low"), F.col("_timeline")))) for name in names])
    fields, source = F.col("_inferred.fields"), F.col("_inferred.source")
    told = F.lit('"inferred"')
    more = F.array(
        pair("applicable_fields", F.to_json(fields)), pair("_applicable_fields_source", F.when(fields.isNotNull(), told)),
        pair("data_source", F.when(source.isNotNull(), _quoted(source))), pair("_data_source_source", F.when(source.isNotNull(), told)),
    )
    known = lambda pairs: F.filter(pairs, lambda x: x["value"].isNotNull() & (x["value"] != ""))
    fix = F.when(bad, F.concat(known(fixes), known(more)))
    df = settled(df.withColumn("_fix", fix).drop("_inferred", "_timeline", "_low"))
    df = df.withColumn("repaired_fields", F.coalesce(F.transform(F.filter("_fix", lambda x: F.array_contains("missing_before", x["key"])), lambda x: x["key"]), lit_array([])))
    # repaired fields take the place of old ones
    new = F.map_from_entries(F.transform("_fix", lambda x: F.struct(x["key"], F.try_parse_json(x["value"]))))
    kept = F.map_filter(F.try_variant_get(a, F.lit("$"), "map<string,variant>"), lambda k, _: ~F.exists("_fix", lambda x: x["key"] == k))
    df = settled(df.withColumn("a", F.when(F.size("_fix") > 0, F.to_variant_object(F.map_concat(kept, new))).otherwise(a)).drop("_fix"))
    df = df.withColumn("missing_fields", at.missing_fields(F.col("a"), kind))
    status = F.when(F.size("missing_before") == 0, "valid").when(F.size("missing_fields") == 0, "repaired").otherwise("rejected")
    return df.withColumn("schema_status", status)
