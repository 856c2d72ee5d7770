"""Requirements from model responses, and everything done to them afterwards."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dims
from ..functions import attributes as at
from ..functions import control, verbs
from ..functions.ids import requirement_id
from ..functions.repair import with_repair
from ..functions.score import TEXTS, clamp, with_confidence, with_texts
from ..functions.text import content_tokens, settled, starts_with_any
from .dedup import leaders
from .graph import written


def clean_content(content: Column) -> Column:
    """Without the code fence around it."""
    x = F.regexp_replace(content, r"^\s+|\s+$", "")
    inner = F.regexp_replace(F.regexp_replace(x, r"\n```$", ""), r"^```[^\n]*\n?", "")
    return F.when(x.startswith("```"), inner).otherwise(x)


def parse_items(responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items (doc_id, batch_id, item_ord, item) and status (doc_id, batch_id, n_items, parse_error) of responses (doc_id, batch_id, content)."""
    parsed = responses.withColumn("v", F.try_parse_json(clean_content(F.col("content"))))
    kind = F.schema_of_variant("v")
    items = F.when(kind.startswith("ARRAY"), F.try_variant_get("v", F.lit("$"), "array<variant>")).when(F.col("v").isNotNull(), F.array("v"))
    parsed = parsed.withColumn("items", items)
    status = parsed.select("doc_id", "batch_id", F.when(F.col("items").isNull(), 0).otherwise(F.size("items")).alias("n_items"), F.col("v").isNull().alias("parse_error"))
    return parsed.select("doc_id", "batch_id", F.posexplode("items").alias("item_ord", "item")), status


def requirements(items: DataFrame, members: DataFrame, schema_version: str = "", prompt_version: str = "", iteration: int = 1) -> DataFrame:
    """Requirements of items; members is (doc_id, batch_id, ord, chunk_id, source_location).

    Unknown rule types are dropped; the source is the chunk an item names, if
    it is in the batch, else the batch's first; confidence defaults to 0.70.
    """
    i = F.col("item")
    rows = items.select(
        "doc_id", "batch_id", "item_ord", at.field(i, "rule_type").alias("rule_type"), F.coalesce(at.field(i, "rule_description"), F.lit("")).alias("rule_description"),
        F.coalesce(at.field(i, "grounded_in"), F.lit("")).alias("grounded_in"), clamp(F.coalesce(at.field(i, "confidence", "double"), F.lit(0.70)), 10).alias("model_confidence"),
        F.coalesce(at.field(i, "attributes", "variant"), F.parse_json(F.lit("{}"))).alias("a"), at.field(i, "source_chunk_id").alias("named"),
    ).where(F.col("rule_type").isin(*dims.RULE_CODES))
    first = members.groupBy("doc_id", "batch_id").agg(F.min_by(F.struct("chunk_id", "source_location"), "ord").alias("first"))
    own = members.select("doc_id", "batch_id", F.col("chunk_id").alias("named"), F.struct("chunk_id", "source_location").alias("own"))
    rows = rows.join(first, ["doc_id", "batch_id"], "left").join(own.dropDuplicates(["doc_id", "batch_id", "named"]), ["doc_id", "batch_id", "named"], "left")
    source = F.coalesce("own", "first")
    return rows.select(
        "doc_id", "batch_id", "item_ord", requirement_id(F.col("rule_type"), F.col("rule_description"), F.col("grounded_in")).alias("requirement_id"), "rule_type", "rule_description",
        "grounded_in", "model_confidence", "a", source["chunk_id"].alias("source_chunk_id"), source["source_location"].alias("source_location"),
        F.lit(schema_version).alias("schema_version"), F.lit(prompt_version).alias("prompt_version"), F.lit(iteration).alias("extraction_iteration"),
    )


def skipped(members: DataFrame, status: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, chunk_id, skip_reason, detail) of the chunks of batches that gave no requirement.

    A batch without a status row had no response: its model call failed.
    """
    some = found.select("doc_id", "batch_id").distinct()
    rows = members.select("doc_id", "batch_id", "chunk_id").join(some, ["doc_id", "batch_id"], "left_anti").join(status, ["doc_id", "batch_id"], "left")
    reason = F.when(F.col("n_items").isNull(), "llm_error").when(F.col("parse_error"), "parse_error").otherwise("no_extractable_content")
    detail = F.concat(F.lit("Batch "), F.col("batch_id").cast("string"), F.lit(": no requirements extracted"))
    return rows.select("doc_id", "chunk_id", reason.alias("skip_reason"), F.when(F.col("n_items").isNull(), "no response").otherwise(detail).alias("detail"))


class TooManyFailures(RuntimeError):
    """More than half of the batches failed."""


def check_failures(members: DataFrame, status: DataFrame, most: float = dims.BATCH_FAILURE_THRESHOLD) -> None:
    batches = members.select("doc_id", "batch_id").distinct()
    row = batches.join(status.withColumn("ok", F.lit(1)), ["doc_id", "batch_id"], "left").agg(F.count("*").alias("n"), F.count("ok").alias("ok")).first()
    if row["n"] and (row["n"] - row["ok"]) / row["n"] > most:
        raise TooManyFailures(f"Too many batch failures: {row['n'] - row['ok']}/{row['n']}")


def deduplicate(reqs: DataFrame, threshold: float = dims.DUPLICATE_SIMILARITY) -> DataFrame:
    """Near-duplicates of one document and rule type reduced to the one of highest confidence. Needs an ordered long req_no, unique in its document."""
    reqs = reqs.withColumn("_scope", F.concat_ws("|", "doc_id", "rule_type"))
    kept = leaders(reqs, "req_no", "_scope", "model_confidence", content_tokens(F.col("rule_description")), threshold).where("kept")
    return reqs.join(kept.select("_scope", F.col("key").alias("req_no")), ["_scope", "req_no"], "left_semi").drop("_scope")


def parent_link(reqs: DataFrame, chunk_index: DataFrame) -> DataFrame:
    return reqs.join(chunk_index.withColumnRenamed("component_id", "parent_component_id"), ["doc_id", "source_chunk_id"], "left")


def with_fragment(df: DataFrame, pronouns: Sequence[str] = dims.REQUIREMENT_PRONOUNS) -> DataFrame:
    hit = starts_with_any(F.lower("rule_description"), tuple(pronouns))
    return df.withColumns({"fragment_warning": hit, "fragment_reason": F.when(hit, "starts_with_demonstrative_pronoun")})


def pass_threshold(iteration: Column, thresholds: Mapping[int, float] = dims.PASS_THRESHOLDS) -> Column:
    return F.when(iteration == 2, thresholds[2]).otherwise(thresholds[1])


def known_texts(reqs: DataFrame) -> DataFrame:
    """Evidence, text features and what ``control.told`` says, once for each type, description and source text of the requirements; written.

    For tables in which the same texts come many times and that are cheap to read twice.
    """
    texts = with_texts(reqs.select(*TEXTS).distinct())
    return written(texts.withColumn("_told", control.told(F.col("rule_type"), F.col("rule_description"))))


def validate_and_adjust(reqs: DataFrame, thresholds: Mapping[int, float] = dims.PASS_THRESHOLDS, pronouns: Sequence[str] = dims.REQUIREMENT_PRONOUNS, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Requirements repaired, scored, filtered and enriched; and those rejected as inference. Narrow throughout, but for a join with ``known_texts``, if given."""
    repaired = with_repair(reqs)
    if known is not None:
        same = [F.col(f"_r.{c}").eqNullSafe(F.col(f"_t.{c}")) for c in TEXTS]
        repaired = repaired.alias("_r").join(known.alias("_t"), same[0] & same[1] & same[2]).select("_r.*", *[f"_t.{c}" for c in known.columns if c not in TEXTS])
    scored = with_confidence(repaired)
    rejected = scored.where("grounding_classification = 'INFERENCE'")
    kept = scored.where("grounding_classification <> 'INFERENCE'").where(F.col("confidence") >= pass_threshold(F.col("extraction_iteration"), thresholds))
    kept = with_fragment(kept, pronouns)
    told = None if known is None else F.col("_told")
    kept = settled(kept.withColumn("_measure", control.measurement_type(F.col("a"), F.col("rule_type"))))
    kept = settled(kept.withColumn("_control", control.metadata(F.col("a"), F.col("rule_type"), F.col("rule_description"), told, F.col("_measure"))).drop("_measure", "_told"))
    scalars = F.map_filter(F.try_variant_get("a", F.lit("$"), "map<string,string>"), lambda k, v: v.isNotNull())
    kept = kept.withColumn("verbs", verbs.replace_vague(F.col("rule_description"), scalars))
    kept = kept.withColumn("actionable_description", F.when(F.col("verbs.has_vague_verbs"), F.col("verbs.replaced")))
    return kept.withColumn("control_metadata", F.col("_control")).drop("_control"), rejected.drop("_told")


def extraction_metadata(reqs: DataFrame, chunks: DataFrame, skips: DataFrame, rejected: DataFrame, *keys: str) -> DataFrame:
    """One row per key: counts, mean confidence, rule types, chunks that gave nothing."""
    types = reqs.groupBy(*keys, "rule_type").count().groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("rule_type", "count")))).alias("rule_type_distribution"))
    main = reqs.groupBy(*keys).agg(F.count("*").alias("total_requirements_extracted"), F.round(F.avg("confidence"), 6).alias("avg_confidence"))
    zero = skips.groupBy(*keys).agg(F.sort_array(F.collect_set("chunk_id")).alias("chunks_with_zero_extractions"))
    inference = rejected.groupBy(*keys).agg(F.count("*").alias("inference_rejected_count"))
    out = chunks.groupBy(*keys).agg(F.count("*").alias("total_chunks_processed"))
    for other in (main, types, zero, inference):
        out = out.join(other, list(keys), "left")
    return out.fillna(0, ["total_requirements_extracted", "avg_confidence", "inference_rejected_count"])
