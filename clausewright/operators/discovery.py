"""Schema discovery: samples, statistics and labels of annotated chunks, and the entities in a model's response.

Chunks have doc_id, position, chunk_type, record_type, record_id,
incomplete_record, table_data, col_count and char_count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import dims
from ..functions.ids import schema_hash
from ..functions.text import let


def stratified_sample(chunks: DataFrame, per_type: int = dims.PER_TYPE_SAMPLE, total: int = dims.TOTAL_SAMPLE, key: str = "doc_id") -> DataFrame:
    """(key, record_type, position, stratum): of each record type full tables, then full prose, then one stub; then others up to the total."""
    stub = F.coalesce("incomplete_record", F.lit(False))
    known = F.coalesce("record_type", F.lit("")) != ""
    stratum = (
        F.when(known & stub, 2).when(known & (F.col("chunk_type") == "table"), 0).when(known & (F.col("chunk_type") == "prose"), 1)
        .when(~known & (F.col("chunk_type") == "table"), 3).when(~known & (F.col("chunk_type") == "prose"), 4)
    )
    rows = chunks.withColumn("stratum", stratum).where("stratum IS NOT NULL")
    of_type = Window.partitionBy(key, "record_type")
    rows = rows.withColumn("in_stratum", F.row_number().over(Window.partitionBy(key, "record_type", "stratum").orderBy("position")))
    full = F.count_if(F.col("stratum").isin(0, 1)).over(of_type)
    rows = rows.withColumn("full", full).withColumn("rank", F.row_number().over(of_type.orderBy("stratum", "position")))
    typed = rows.where(known).where(F.when(F.col("stratum") == 2, (F.col("in_stratum") == 1) & (F.col("full") < per_type)).otherwise(F.col("rank") <= per_type))
    taken = typed.groupBy(key).agg(F.count("*").alias("taken"))
    rest = rows.where(~known).join(taken, key, "left").withColumn("slots", F.greatest(F.lit(total) - F.coalesce("taken", F.lit(0)), F.lit(0)))
    tables = F.least(F.count_if(F.col("stratum") == 3).over(Window.partitionBy(key)), F.lit(2), F.col("slots"))
    rest = rest.withColumn("tables", tables)
    rest = rest.where(F.when(F.col("stratum") == 3, F.col("in_stratum") <= F.col("tables")).otherwise(F.col("in_stratum") <= F.col("slots") - F.col("tables")))
    columns = [key, "record_type", "position", "stratum"]
    return typed.select(*columns).unionByName(rest.select(*columns))


def entity_stats(chunks: DataFrame, *keys: str) -> DataFrame:
    """Chunks, distinct records, full and stub chunks and sorted ids of each record type."""
    stub = F.coalesce("incomplete_record", F.lit(False))
    known = chunks.where(F.coalesce("record_type", F.lit("")) != "")
    return known.groupBy(*keys, "record_type").agg(
        F.count("*").alias("total_chunks"),
        F.count_distinct("record_id").alias("unique_records"),
        F.count_if(~stub).alias("full_records"),
        F.count_if(stub).alias("stub_records"),
        F.sort_array(F.collect_set("record_id")).alias("record_ids"),
    )


def field_labels(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, record_type, raw_label, example_value, source): first seen wins, in order of chunks, rows and cells."""
    rows = chunks.where(F.size("table_data") >= 2).withColumn("record_type", F.coalesce("record_type", F.lit("unknown")))
    down = F.transform(F.filter("table_data", lambda r: F.size(r) >= 2), lambda r: F.struct(F.trim(F.coalesce(r[0], F.lit(""))).alias("label"), F.trim(F.coalesce(r[1], F.lit(""))).alias("value")))
    across = F.transform(F.col("table_data")[0], lambda c, i: F.struct(F.trim(F.coalesce(c, F.lit(""))).alias("label"), F.coalesce(F.get(F.col("table_data")[1], i), F.lit("")).alias("value")))
    vertical = F.col("col_count") == 2
    each = rows.select(key, "record_type", "position", F.when(vertical, "table_kv").otherwise("table_horizontal").alias("source"), F.posexplode(F.when(vertical, down).otherwise(across)).alias("i", "c"))
    each = each.select(key, "record_type", "position", "i", "source", F.col("c.label").alias("raw_label"), F.substring("c.value", 1, 100).alias("example_value")).where("raw_label <> ''")
    first = F.row_number().over(Window.partitionBy(key, "record_type", "raw_label").orderBy("position", "i"))
    return each.withColumn("rn", first).where("rn = 1").select(key, "record_type", "raw_label", "example_value", "source")


def infer_type(example):
    """identifier, date, number, boolean, enum or text, by the look of an example value."""
    return (
        F.when(example.rlike(r"^[A-Z]{1,4}-\d+$"), "identifier").when(example.rlike(r"^\d{4}-\d{2}-\d{2}"), "date").when(example.rlike(r"^[$]?\d[\d,]*\.?\d*%?$"), "number")
        .when(F.lower(example).isin("true", "false", "yes", "no", "y", "n"), "boolean").when(example.rlike(r"^[A-Za-z]+$"), "enum").otherwise("text")
    )


FIELD = "struct<raw_label:string,inferred_type:string,confidence:double,example_values:array<string>>"
ENTITIES = f"array<struct<discovered_label:string,record_count:bigint,fields:array<{FIELD}>>>"


def discovered_schema(chunks: DataFrame, key: str = "doc_id", confidence: float = 0.5) -> DataFrame:
    """One schema map per key from statistics and labels alone: key, entities, total_records_estimated, avg_confidence, schema_version."""
    labels = field_labels(chunks, key).withColumn("inferred_type", infer_type(F.col("example_value")))
    fields = labels.groupBy(key, "record_type").agg(
        F.sort_array(F.collect_list(F.struct("raw_label", "inferred_type", F.lit(confidence).alias("confidence"), F.array("example_value").alias("example_values")))).alias("fields")
    )
    entities = entity_stats(chunks, key).join(fields, [key, "record_type"], "full").fillna(0, ["unique_records"])
    entity = F.struct(F.upper("record_type").alias("discovered_label"), F.col("unique_records").alias("record_count"), F.coalesce("fields", F.array().cast(fields.schema["fields"].dataType)).alias("fields"))
    return schema_maps(entities.groupBy(key).agg(F.sort_array(F.collect_list(entity)).alias("entities")))


def schema_maps(entities: DataFrame) -> DataFrame:
    """Adds total_records_estimated, avg_confidence and schema_version to keys with entities."""
    total = F.aggregate("entities", F.lit(0).cast("long"), lambda s, e: s + e["record_count"])
    values = F.flatten(F.transform("entities", lambda e: F.transform(e["fields"], lambda f: f["confidence"])))
    mean = F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / F.size(values)).otherwise(0.0)
    return entities.withColumns({"total_records_estimated": total, "avg_confidence": mean, "schema_version": schema_hash(F.to_json("entities"))})


def read_entities(content: Column) -> Column:
    """ENTITIES of a model's response; null if it is no object with an entity that has a label.

    Entities without a label and fields without one are left out; counts below 0 become 0, confidences
    outside [0, 1] or missing 0.5, missing types text.
    """
    told = F.from_json(F.to_json(F.try_variant_get(F.try_parse_json(content), F.lit("$.entities"), "variant")), ENTITIES)
    label = lambda x, name: F.trim(F.coalesce(x[name], F.lit("")))
    field = lambda f: F.struct(
        label(f, "raw_label").alias("raw_label"), F.coalesce(F.nullif(label(f, "inferred_type"), F.lit("")), F.lit("text")).alias("inferred_type"),
        F.when(f["confidence"].between(0.0, 1.0), f["confidence"]).otherwise(0.5).alias("confidence"), F.coalesce(f["example_values"], F.array().cast("array<string>")).alias("example_values"),
    )
    none = F.array().cast(f"array<{FIELD}>")
    fields = lambda e: F.transform(F.filter(F.coalesce(e["fields"], none), lambda f: label(f, "raw_label") != ""), field)
    entity = lambda e: F.struct(label(e, "discovered_label").alias("discovered_label"), F.greatest(F.coalesce(e["record_count"], F.lit(0)), F.lit(0)).cast("long").alias("record_count"), fields(e).alias("fields"))
    return let(F.transform(F.filter(told, lambda e: label(e, "discovered_label") != ""), entity), lambda x: F.when(F.size(x) > 0, x))


def avg_confidence(fields: DataFrame, confidence: str, *keys: str) -> DataFrame:
    """Mean field confidence, 0 without fields."""
    return fields.groupBy(*keys).agg(F.round(F.coalesce(F.avg(confidence), F.lit(0.0)), 6).alias("avg_confidence"))
