"""Prompts as versioned text, built per document, record type or batch by DataFrame expressions."""

from __future__ import annotations

import functools
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dims

PREVIEW = 800

RULE_TYPES = ", ".join(dims.RULE_CODES)
#: Where the document's schema goes in the instructions.
SCHEMA = "{schema}"
#: Instructions by node and version; a YAML file of the same name in a folder of one's own replaces them.
TEXTS = {
    ("schema_discovery", "v1.0"): "You describe the structure of a document.\n\nList its entities and their fields as JSON: an object with a list entities of objects with discovered_label, record_count and fields; each field has raw_label, inferred_type, confidence and example_values. Use only the labels and counts given; leave relationships empty.",
    ("components", "v1.0"): f"You read governance records out of tables.\n\nReturn a JSON array with one object per record: component_id, component_type, title, and the fields found, with references to other records as lists of ids. Leave out what the text does not say.\n\n{SCHEMA}",
    ("requirements", "v1.0"): f"You read atomic requirements out of regulatory text.\n\nReturn a JSON array with one object per requirement: rule_type, rule_description, grounded_in (verbatim from its chunk), confidence (0.50 to 0.99), attributes, source_chunk_id (as given). One obligation each; nothing that the text does not state. Rule types: {RULE_TYPES}.\n\n{SCHEMA}",
    ("requirements", "v1.0_retry"): f"You read atomic requirements out of regulatory text that a first pass read badly.\n\nReturn a JSON array as before: rule_type, rule_description, grounded_in, confidence, attributes, source_chunk_id. Quote grounded_in verbatim; do not infer; leave out what you would give a confidence below 0.70. Rule types: {RULE_TYPES}.\n\n{SCHEMA}",
}


@functools.lru_cache(maxsize=None)
def load(node: str, version: str = "v1.0", folder: str | None = None) -> str:
    """The instructions, cached; KeyError if there are none."""
    if folder and (path := Path(folder) / node / f"{version}.yaml").exists():
        import yaml

        return str(yaml.safe_load(path.read_text())["system"])
    return TEXTS[node, version]


def version_of(iteration: int) -> str:
    """The second pass has its own prompt."""
    return "v1.0_retry" if iteration == 2 else "v1.0"


def temperature_of(iteration: int, first: float = 0.1, retry: float = 0.0) -> float:
    return retry if iteration == 2 else first


def preview(text: Column) -> Column:
    """The start of a chunk for orientation; extraction itself gets whole chunks."""
    return F.concat(F.substring(text, 1, PREVIEW), F.when(F.length(text) > PREVIEW, "...").otherwise(""))


def chunk_block(df: DataFrame) -> Column:
    """A chunk as prompts show it: id, type and record in a first line, location and heading, then the text with its line breaks."""
    known = set(df.columns)
    has = lambda c: F.coalesce(F.col(c), F.lit("")) if c in known else F.lit("")
    record = F.when(has("record_type") != "", F.concat(F.lit(" record: "), F.upper(has("record_type")), F.when(has("record_id") != "", F.concat(F.lit(" "), has("record_id"))).otherwise(""))).otherwise("")
    head = F.concat(F.lit("=== CHUNK ["), F.col("chunk_id"), F.lit("] "), F.upper(has("chunk_type")), record, F.lit(" ==="))
    where = F.concat(F.lit("Location: "), has("source_location"), F.lit("\nHeading: "), F.when(has("parent_heading") != "", has("parent_heading")).otherwise("none"))
    return F.concat(head, F.lit("\n"), where, F.lit("\n\n"), F.coalesce("content_text", F.lit("")))


def with_schema(node: str, version: str, context: Column, folder: str | None = None) -> Column:
    """The instructions with a document's schema in their place for it."""
    before, mark, after = load(node, version, folder).partition(SCHEMA)
    return F.concat(F.lit(before), F.coalesce(context, F.lit("")), F.lit(after)) if mark else F.concat(F.lit(before), F.coalesce(F.concat(F.lit("\n\n"), context), F.lit("")))


def discovery_prompts(sampled: DataFrame, stats: DataFrame, labels: DataFrame, folder: str | None = None, temperature: float = 0.0) -> DataFrame:
    """(doc_id, prompt): counts and labels by entity, then previews of the sampled chunks (doc_id, position, content_text)."""
    line = F.concat(F.lit("- "), "record_type", F.lit(": "), F.col("unique_records").cast("string"), F.lit(" records, "), F.col("full_records").cast("string"), F.lit(" full chunks"))
    entities = stats.groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("entities"))
    label = F.concat(F.lit("- "), "record_type", F.lit(": "), "raw_label", F.lit(" (e.g. "), "example_value", F.lit(")"))
    fields = labels.groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_list(label)), "\n").alias("fields"))
    text = F.transform(F.sort_array(F.collect_list(F.struct("position", preview(F.col("content_text")).alias("t")))), lambda x: x["t"])
    chunks = sampled.groupBy("doc_id").agg(F.array_join(text, "\n---\n").alias("chunks"))
    out = chunks.join(entities, "doc_id", "left").join(fields, "doc_id", "left")
    return out.select("doc_id", F.concat_ws("\n\n", F.lit(load("schema_discovery", folder=folder)), "entities", "fields", "chunks").alias("prompt"), F.lit(float(temperature)).alias("temperature"))


def extractable(chunks: DataFrame) -> DataFrame:
    """Table chunks of a record type, lower-cased: what components are read from."""
    return chunks.where((F.col("chunk_type") == "table") & (F.coalesce("record_type", F.lit("")) != "")).withColumn("record_type", F.lower("record_type"))


def schema_context(schemas: DataFrame) -> DataFrame:
    """(doc_id, context): format and entities with their fields, for the prompts after discovery."""
    entity = lambda e: F.concat_ws("\n", F.concat(F.lit("  "), e["discovered_label"], F.lit(", "), F.coalesce(e["record_count"].cast("string"), F.lit("0")), F.lit(" records")), F.array_join(F.transform(e["fields"], lambda f: F.concat(F.lit("    "), f["raw_label"], F.lit(" ("), f["inferred_type"], F.lit(")"))), "\n"))
    form = F.col("document_format") if "document_format" in schemas.columns else F.lit("docx")
    return schemas.where("entities IS NOT NULL").select("doc_id", F.concat(F.lit("Schema of the document (format "), form, F.lit("):\n"), F.array_join(F.transform("entities", entity), "\n")).alias("context"))


def component_prompts(chunks: DataFrame, schemas: DataFrame | None = None, folder: str | None = None) -> DataFrame:
    """(doc_id, record_type, prompt): all table chunks of each record type, after the instructions and the document's schema."""
    rows = extractable(chunks)
    text = F.transform(F.sort_array(F.collect_list(F.struct("position", chunk_block(rows).alias("t")))), lambda x: x["t"])
    grouped = rows.groupBy("doc_id", "record_type").agg(F.array_join(text, "\n\n").alias("chunks"))
    grouped = grouped.join(schema_context(schemas), "doc_id", "left") if schemas is not None else grouped.withColumn("context", F.lit(None).cast("string"))
    head = with_schema("components", "v1.0", F.col("context"), folder)
    return grouped.select("doc_id", "record_type", F.concat(head, F.lit("\n\nRecord type: "), "record_type", F.lit("\n\n"), "chunks").alias("prompt"), F.lit(0.0).alias("temperature"))


def requirement_prompts(members: DataFrame, chunks: DataFrame, schemas: DataFrame | None = None, iteration: int = 1, folder: str | None = None, temperatures: tuple[float, float] = (0.1, 0.0)) -> DataFrame:
    """(doc_id, batch_id, prompt, temperature): instructions of the pass, the document's schema, and the chunks of each batch in order."""
    rows = members.join(chunks.withColumn("pos", F.col("position").cast("long")), ["doc_id", "pos"])
    grouped = rows.groupBy("doc_id", "batch_id").agg(F.sort_array(F.collect_list(F.struct("ord", chunk_block(rows).alias("t")))).alias("x"))
    grouped = grouped.join(schema_context(schemas), "doc_id", "left") if schemas is not None else grouped.withColumn("context", F.lit(None).cast("string"))
    head = with_schema("requirements", version_of(iteration), F.col("context"), folder)
    body = F.array_join(F.transform("x", lambda y: y["t"]), "\n\n")
    return grouped.select("doc_id", "batch_id", F.concat(head, F.lit("\n\n"), body).alias("prompt"), F.lit(float(temperature_of(iteration, *temperatures))).alias("temperature"))
