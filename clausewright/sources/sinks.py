"""Outputs: JSON documents, flat exports, keyed tables, listings, schema cache."""

from __future__ import annotations

import uuid
from datetime import datetime, timezone
from pathlib import PurePosixPath

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import attributes as at
from ..operators.insights import export_rows


def run_name(kind: str, source: str, now: datetime | None = None, tag: str | None = None) -> str:
    """<kind>_<stem>_<UTC time>_<8 hex digits>.json"""
    now = now or datetime.now(timezone.utc)
    return f"{kind}_{PurePosixPath(source).stem}_{now:%Y%m%d_%H%M%S}_{tag or uuid.uuid4().hex[:8]}.json"


def _filled(x: Column) -> Column:
    return F.when(x != "", x)


def output_json(reqs: DataFrame) -> Column:
    """A requirement as it is published: nulls, empty lists and internal fields left out, control metadata promoted.

    The system mapping is shown only where it was found in the text; the
    source text only where it differs from the description.
    """
    m = "control_metadata"
    listed = lambda c: F.when(F.size(c) > 0, F.col(c))
    grounding = F.struct(F.col("jaccard_score"), F.when((F.col("grounded_in") != F.col("rule_description")), _filled(F.col("grounded_in"))).alias("source_text"))
    features = F.struct("grounding_match", "completeness", "quantification", "schema_compliance", "coherence", "domain_signals", "raw_total")
    fixed = F.struct(
        "requirement_id", "rule_type", "rule_description", F.round("confidence", 2).alias("confidence"), grounding.alias("grounding"), features.alias("confidence_features"), F.col("rationale").alias("confidence_rationale"),
        _filled(F.col(f"{m}.control_objective")).alias("control_objective"), listed(f"{m}.risk_addressed").alias("risk_addressed"), _filled(F.col(f"{m}.control_owner")).alias("control_owner"),
        _filled(F.col(f"{m}.test_procedure")).alias("test_procedure"), listed(f"{m}.evidence_type").alias("evidence_type"),
        F.when(F.col(f"{m}.system_mapping_source") != "default_template", F.col(f"{m}.system_mapping")).alias("system_mapping"),
        F.when(F.size(F.map_keys(f"{m}.exception_threshold")) > 0, F.col(f"{m}.exception_threshold")).alias("exception_thresholds"), F.col(f"{m}.automated").alias("automation_level"),
    )
    own = F.map_filter(F.try_variant_get("a", F.lit("$"), "map<string,variant>"), lambda k, v: ~F.coalesce(F.schema_of_variant(v), F.lit("VOID")).isin("VOID", "ARRAY<VOID>", "OBJECT<>"))
    inner = lambda x: F.regexp_replace(x, r"(?s)^\{|\}$", "")
    meta = F.to_json(F.struct(F.struct("source_chunk_id", "source_location").alias("metadata")))
    parts = F.filter(F.array(inner(F.to_json(fixed)), inner(F.coalesce(F.to_json(own), F.lit("{}"))), inner(meta)), lambda x: x != "")
    return F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}"))


def write_requirements(reqs: DataFrame, path: str) -> None:
    reqs.select("doc_id", output_json(reqs).alias("value")).select("value").write.mode("overwrite").text(path)


def payload(requirements: DataFrame, metadata: DataFrame, gates: DataFrame, insights: DataFrame, skipped: DataFrame) -> DataFrame:
    """(doc_id, value): one JSON object per document with extraction_metadata, gate_decision, summary, insights, skipped_chunks and requirements.

    A document's requirements are one array in the order they were read (req_no), as the format has it: its size is that of the document.
    """
    level = F.coalesce(F.col("control_metadata.automated"), F.lit("manual"))
    auto = [F.count_if(level == x).alias(x) for x in ("automated", "hybrid", "manual")]
    rows = requirements.select("doc_id", "confidence", "control_metadata", "rule_type", F.struct("req_no", output_json(requirements).alias("j")).alias("r"))
    by_doc = rows.groupBy("doc_id").agg(F.count("*").alias("total_requirements"), F.round(F.avg("confidence"), 3).alias("avg_confidence"), *auto, F.transform(F.sort_array(F.collect_list("r")), lambda x: x["j"]).alias("js"))
    skips = skipped.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("chunk_id", "skip_reason", "detail"))).alias("skips"))
    whole = lambda df, name: df.select("doc_id", F.to_json(F.struct(*[c for c in df.columns if c != "doc_id"])).alias(name))
    gate = gates.select("doc_id", "decision", "score", "rationale", "failing_checks", "conditional_flags")
    out = whole(gate, "gate_json").join(whole(metadata, "meta_json"), "doc_id", "left").join(whole(insights, "insight_json"), "doc_id", "left")
    out = out.join(metadata.select("doc_id", "rule_type_distribution"), "doc_id", "left").join(by_doc, "doc_id", "left").join(skips, "doc_id", "left")
    summary = F.to_json(F.struct(F.coalesce("total_requirements", F.lit(0)).alias("total_requirements"), F.coalesce("rule_type_distribution", F.create_map().cast("map<string,bigint>")).alias("by_rule_type"), F.coalesce("avg_confidence", F.lit(0.0)).alias("avg_confidence"), F.struct(*[F.coalesce(x, F.lit(0)).alias(x) for x in ("automated", "hybrid", "manual")]).alias("automation_breakdown")))
    none = F.lit("{}")
    listed = F.coalesce(F.to_json("skips"), F.lit("[]"))
    parts = {"extraction_metadata": F.coalesce("meta_json", none), "gate_decision": F.col("gate_json"), "summary": summary, "insights": F.coalesce("insight_json", none), "skipped_chunks": listed, "requirements": F.concat(F.lit("["), F.coalesce(F.array_join("js", ","), F.lit("")), F.lit("]"))}
    return out.select("doc_id", F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(f'"{k}":'), v) for k, v in parts.items()]), F.lit("}")).alias("value"))


def write_export(reqs: DataFrame, path: str) -> None:
    """The flat export as CSV with a header."""
    rows = reqs.withColumns({"applicable_fields": at.field(F.col("a"), "applicable_fields", "array<string>"), "data_source": at.field(F.col("a"), "data_source"), "control_type": at.field(F.col("a"), "control_type")})
    export_rows(rows).write.mode("overwrite").option("header", True).csv(path)


def latest(existing: DataFrame, new: DataFrame, key: str = "requirement_id") -> DataFrame:
    """Existing rows with new ones in place of those of the same key: the relation an upsert leaves."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    order = Window.partitionBy(key).orderBy(F.col("_new").desc(), *[F.col(c) for c in new.columns if c != key and dict(new.dtypes)[c] != "variant"])
    return both.withColumn("_rn", F.row_number().over(order)).where("_rn = 1").drop("_rn", "_new")


def list_outputs(spark: SparkSession, folder: str) -> DataFrame:
    """(filename, label, modified) of requirements_*.json, newest first."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "requirements_*.json").load(folder).select("path", F.col("modificationTime").alias("modified"))
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(name.alias("filename"), F.regexp_replace(name, r"^requirements_|\.json$", "").alias("label"), "modified").orderBy(F.desc("modified"), "filename")


def read_output(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One output file of the folder; names that lead out of it are refused."""
    if "/" in name or "\\" in name or name in ("", ".", ".."):
        raise PermissionError("Access denied")
    return spark.read.option("multiLine", True).json(f"{folder.rstrip('/')}/{name}")


def manifest_entry(filename: Column) -> Column:
    """Struct of label and timestamp from a run name; the bare name where it has no time."""
    base = F.regexp_replace(filename, r"\.json$", "")
    date = lambda i: F.regexp_extract(base, r"_(\d{4})(\d{2})(\d{2})_(\d{2})(\d{2})\d{2}_[^_]+$", i)
    timed = date(1) != ""
    day, clock = F.concat_ws("-", date(1), date(2), date(3)), F.concat_ws(":", date(4), date(5))
    words = F.regexp_replace(F.regexp_replace(F.regexp_replace(base, r"_\d{8}_\d{6}_[^_]+$", ""), r"^[^_]+_", ""), "_", " ")
    return F.struct(F.when(timed, F.concat(words, F.lit(" - "), day, F.lit(" "), clock)).otherwise(base).alias("label"), F.when(timed, F.concat(day, F.lit("T"), clock, F.lit(":00"))).alias("timestamp"))


def cache_schema(schemas: DataFrame, path: str) -> None:
    """Schema maps by lower-cased source_tool, one folder each; those of other tools stay."""
    out = schemas.withColumn("source_tool", F.lower("source_tool"))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source_tool").parquet(path)


def cached_schema(spark: SparkSession, path: str, source_tool: str) -> DataFrame | None:
    """The cached schema map, null if there is none or it cannot be read."""
    try:
        found = spark.read.parquet(path).where(F.col("source_tool") == source_tool.lower())
        return found if found.limit(1).count() else None
    except Exception:
        return None


RESPONSES = "key string, content string"


def cached_responses(spark: SparkSession, path: str | None) -> DataFrame:
    """Responses (key, content) that were kept under a path; none if there is no such table yet."""
    try:
        if path:
            return spark.read.schema(RESPONSES).parquet(path).dropDuplicates(["key"])
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    return spark.createDataFrame([], RESPONSES)


def keep_responses(responses: DataFrame, path: str) -> None:
    """Adds responses (key, content) to those under a path; keys that are there already should have been left out."""
    responses.select("key", "content").write.mode("append").parquet(path)
