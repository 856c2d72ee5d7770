"""Policies, risks and controls: parsing, normalising, cross references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import attributes as at

#: Relation fields and the kind that a message names, by component type, in order.
CHECKED = {
    "policy": (("related_controls", "control"), ("related_risks", "risk")),
    "risk": (("related_controls", "control"), ("mitigation_controls", "control"), ("related_policies", "policy")),
    "control": (("related_policies", "policy"), ("related_risks", "risk")),
}
RELATIONS = ("related_controls", "related_risks", "related_policies", "mitigation_controls")
LISTS = (*RELATIONS, "related_regulations", "detailed_requirements", "roles_responsibilities")


def split_list(text: Column) -> Column:
    """Items between commas, semicolons or line breaks, trimmed, without blanks; empty for null."""
    items = F.filter(F.transform(F.split(text, "[,;\n]"), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(text.isNull(), F.array().cast("array<string>")).otherwise(items)


def list_field(a: Column, name: str) -> Column:
    """A list, a separated string or a scalar as an array of trimmed texts."""
    kind = at.kind_of(a, name)
    listed = F.filter(F.transform(at.field(a, name, "array<string>"), lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))
    return (
        F.when(~at.has_value(a, name), F.array().cast("array<string>")).when(kind.startswith("ARRAY"), F.coalesce(listed, F.array().cast("array<string>")))
        .when(kind == "STRING", split_list(at.field(a, name))).otherwise(F.array(at.field(a, name)))
    )


def date_text(text: Column) -> Column:
    """Trimmed, null if blank; dates stay as they are written."""
    x = F.trim(text)
    return F.when(x != "", x)


def control_type(text: Column) -> Column:
    """Struct of raw, nature, automation: "A / B" splits into its first two parts."""
    parts = F.transform(F.split(text, "/"), lambda x: F.trim(x))
    two = F.contains(text, F.lit("/"))
    return F.struct(F.when(~two, text).alias("raw"), F.when(two, parts[0]).alias("nature"), F.when(two, parts[1]).alias("automation"))


def parse(responses: DataFrame, chunks: DataFrame) -> DataFrame:
    """Components of model responses (doc_id, record_type, content): the JSON array inside each text, item by item.

    A component's source is the last chunk of the document annotated with its id.
    """
    body = F.try_parse_json(F.regexp_extract("content", r"(?s)\[.*\]", 0))
    items = responses.select("doc_id", "record_type", F.posexplode(F.try_variant_get(body, F.lit("$"), "array<variant>")).alias("ord", "a"))
    items = items.where(F.schema_of_variant("a").startswith("OBJECT"))
    a = F.col("a")
    out = items.select(
        "doc_id", F.col("record_type").alias("component_type"), "ord", at.field(a, "component_id").alias("component_id"), at.field(a, "title").alias("title"),
        *[list_field(a, x).alias(x) for x in LISTS], date_text(at.field(a, "effective_date")).alias("effective_date"), date_text(at.field(a, "review_cycle")).alias("review_cycle"),
        F.when(F.col("record_type") == "control", control_type(at.field(a, "control_type"))).alias("control_type"), a.alias("extras"),
    )
    last = chunks.where("annotations.record_id IS NOT NULL").groupBy("doc_id", F.col("annotations.record_id").alias("component_id"))
    last = last.agg(F.max_by(F.struct(F.col("chunk_id").alias("source_chunk_id"), "source_location"), "position").alias("src"))
    return out.join(last, ["doc_id", "component_id"], "left").select("*", "src.source_chunk_id", "src.source_location").drop("src")


def edges(components: DataFrame, *keys: str) -> DataFrame:
    """(keys, src, src_type, relation, dst): one row per reference in a field that its type is checked for."""
    parts = []
    for kind, fields in CHECKED.items():
        for name, target in fields:
            parts.append(F.when(F.col("component_type") == kind, _refs(name, target)))
    all_refs = F.flatten(F.filter(F.array(*parts), lambda x: x.isNotNull()))
    each = components.select(*keys, F.col("component_id").alias("src"), F.col("component_type").alias("src_type"), F.explode(all_refs).alias("e"))
    return each.select(*keys, "src", "src_type", "e.relation", "e.target", "e.dst").where("dst <> ''")


def _refs(name: str, target: str) -> Column:
    return F.transform(name, lambda x: F.struct(F.lit(name).alias("relation"), F.lit(target).alias("target"), x.alias("dst")))


def missing_references(components: DataFrame, *keys: str) -> DataFrame:
    """Edges to ids that do not exist, with a message."""
    ids = components.select(*keys, F.col("component_id").alias("dst")).where("dst IS NOT NULL").distinct()
    out = edges(components, *keys).join(ids, [*keys, "dst"], "left_anti")
    message = F.concat(F.initcap("src_type"), F.lit(" "), F.col("src"), F.lit(" references missing "), F.col("target"), F.lit(" "), F.col("dst"))
    return out.withColumn("message", message)


def reference_index(components: DataFrame, *keys: str) -> DataFrame:
    """(keys, component_id, refs): distinct references of each component that has any."""
    return edges(components, *keys).groupBy(*keys, F.col("src").alias("component_id")).agg(F.sort_array(F.collect_set("dst")).alias("refs"))


def chunk_index(components: DataFrame, *keys: str) -> DataFrame:
    """(keys, source_chunk_id, component_id): the last component of each chunk, policies before risks before controls."""
    rank = F.when(F.col("component_type") == "policy", 0).when(F.col("component_type") == "risk", 1).otherwise(2)
    known = components.where("source_chunk_id IS NOT NULL AND component_id IS NOT NULL")
    return known.groupBy(*keys, "source_chunk_id").agg(F.max_by("component_id", F.struct(rank, F.col("ord"))).alias("component_id"))


def summary(components: DataFrame, *keys: str) -> DataFrame:
    of = lambda kind: F.count_if(F.col("component_type") == kind)
    return components.groupBy(*keys).agg(of("policy").alias("policies"), of("risk").alias("risks"), of("control").alias("controls"), F.count("*").alias("total"))
