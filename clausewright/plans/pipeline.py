"""The whole flow as lazy DataFrames: blocks, chunks, schema, gate, components, batches, requirements, report, insights."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config
from ..operators import atomize, chunking, components, discovery, evaluate, gate, insights
from ..operators.graph import durable
from ..sources import prompts, sinks
from ..sources.extractor import Extractor, deterministic, extract


@dataclass
class Run:
    """Everything a run gives; only what is read is computed."""

    chunks: DataFrame
    stats: DataFrame
    schema: DataFrame
    gate: DataFrame
    components: DataFrame | None
    missing_references: DataFrame | None
    members: DataFrame
    prompts: DataFrame
    requirements: DataFrame
    rejected: DataFrame
    skipped: DataFrame
    metadata: DataFrame
    report: DataFrame
    insights: DataFrame

    def payload(self) -> DataFrame:
        """(doc_id, value): the published JSON object of each document."""
        return sinks.payload(self.requirements, self.metadata, self.gate, self.insights, self.skipped)


def flat_chunks(chunks: DataFrame) -> DataFrame:
    """Chunks with the fields of their annotations as columns."""
    return chunks.select("*", "annotations.record_type", "annotations.record_id", "annotations.incomplete_record")


def read_components(flat: DataFrame, chunks: DataFrame, schemas: DataFrame, extractor: Extractor, prompt_folder: str | None = None) -> DataFrame:
    """Components by record type from the responses to their prompts. Types other than the three known ones are left out."""
    asked = prompts.component_prompts(flat, schemas, prompt_folder).where(F.col("record_type").isin(*components.CHECKED))
    responses = durable(extract(asked, extractor, "doc_id", "record_type"))
    return components.parse(responses.where("content IS NOT NULL"), chunks)


def read_schemas(flat: DataFrame, extractor: Extractor, cache: str | None = None, config: Config | None = None, prompt_folder: str | None = None) -> DataFrame:
    """Schema maps of documents as a model describes them, those from statistics where it gives none.

    A response belongs to its prompt: those under ``cache`` are used again, and only documents whose prompts are not among them are asked about;
    the valid ones among the new responses are added. Equal prompts are asked once.
    """
    cfg, spark = config or Config(), flat.sparkSession
    picked = discovery.stratified_sample(flat, cfg.get("schema_discovery.max_chunks_per_entity_type"), cfg.get("schema_discovery.max_total_chunks"))
    picked = picked.select("doc_id", "position").join(flat.select("doc_id", "position", "content_text"), ["doc_id", "position"])
    asked = prompts.discovery_prompts(picked, discovery.entity_stats(flat, "doc_id"), discovery.field_labels(flat), prompt_folder, cfg.get("llm.temperature", 0.0))
    asked = durable(asked.withColumn("key", F.sha2("prompt", 256)))
    known = sinks.cached_responses(spark, cache)
    missing = asked.dropDuplicates(["key"]).join(known, "key", "left_anti")
    told = durable(extract(missing, extractor, "key").select("key", atomize.clean_content(F.col("content")).alias("content")))
    valid = told.where(discovery.read_entities(F.col("content")).isNotNull())
    if cache and valid.limit(1).count():
        sinks.keep_responses(valid, cache)
    read = known.unionByName(told).select("key", discovery.read_entities(F.col("content")).alias("entities")).where("entities IS NOT NULL")
    by_model = discovery.schema_maps(asked.select("doc_id", "key").join(read, "key").drop("key"))
    rest = discovery.discovered_schema(flat).join(by_model.select("doc_id"), "doc_id", "left_anti")
    columns = ["doc_id", "entities", "total_records_estimated", "avg_confidence", "schema_version"]
    return durable(by_model.select(*columns).unionByName(rest.select(*columns)))


def run(
    blocks: DataFrame, extractor: Extractor = deterministic, most: int | None = None, least: int | None = None, iteration: int = 1, parsed_components: DataFrame | None = None,
    component_extractor: Extractor | None = None, schema: DataFrame | None = None, config: Config | None = None,
    schema_extractor: Extractor | None = None, schema_cache: str | None = None, prompt_folder: str | None = None,
) -> Run:
    """Documents whose gate rejects them give no requirements; those without a schema are rejected. Responses are checkpointed: they need not repeat.

    schema: schema maps found otherwise (by a model, or cached) in place of those from statistics; component_extractor reads
    components from their prompts, schema_extractor schema maps from theirs, with a table of earlier responses at schema_cache;
    prompt_folder has instructions of one's own; iteration 2 has its own prompt, temperature and threshold; config sets sizes and thresholds.
    """
    cfg = config or Config()
    chunks, stats = chunking.chunk_blocks(blocks, most or cfg.get("preprocessing.max_chunk_chars"), least or cfg.get("preprocessing.min_chunk_chars"))
    flat = flat_chunks(chunks)
    if schema is None:
        schema = discovery.discovered_schema(flat) if schema_extractor is None else read_schemas(flat, schema_extractor, schema_cache, cfg, prompt_folder)
    judged = gate.decide(chunks.select("doc_id").distinct().join(schema, "doc_id", "left").withColumn("document_format", F.lit("docx")), cfg.gates())
    open_docs = judged.where("decision <> 'reject'").select("doc_id")
    open_flat = flat.join(open_docs, "doc_id", "left_semi")
    if parsed_components is None and component_extractor is not None:
        parsed_components = read_components(open_flat, chunks, judged, component_extractor, prompt_folder)
    members = chunking.build_batches(open_flat, budget=cfg.get("atomizer.batch_processing.max_batch_chars"))
    named = members.join(chunks.select("doc_id", F.col("position").cast("long").alias("pos"), "chunk_id", "source_location"), ["doc_id", "pos"])
    asked = prompts.requirement_prompts(members, flat, judged, iteration, prompt_folder, cfg.temperatures())
    responses = durable(extract(asked, extractor, "doc_id", "batch_id"))
    items, status = atomize.parse_items(responses.where("content IS NOT NULL"))
    atomize.check_failures(named, status, cfg.get("atomizer.failure_handling.batch_failure_threshold"))
    found = atomize.requirements(items, named, prompt_version=prompts.version_of(iteration), iteration=iteration)
    # numbered within their documents, so that runs over different documents can be put together
    found = durable(found.withColumn("req_no", F.row_number().over(Window.partitionBy("doc_id").orderBy("batch_id", "item_ord")).cast("long")))
    unique = durable(atomize.deduplicate(found, cfg.get("deduplication.jaccard_similarity_threshold")))
    if parsed_components is not None:
        unique = atomize.parent_link(unique, components.chunk_index(parsed_components, "doc_id"))
    kept, rejected = atomize.validate_and_adjust(unique, cfg.pass_thresholds(), cfg.get("atomizer.fragment_detection.pronouns"))
    kept = durable(kept.withColumn("a_json", F.to_json("a")).drop("a")).withColumn("a", F.parse_json("a_json"))
    skips = atomize.skipped(named, status, found)
    missing = None if parsed_components is None else components.missing_references(parsed_components, "doc_id")
    return _summed(Run(chunks, stats, schema, judged, parsed_components, missing, members, asked, kept, rejected, skips, skips, skips, skips))


def _summed(r: Run) -> Run:
    """With metadata, report and insights of what was kept."""
    kept = r.requirements
    metadata = atomize.extraction_metadata(kept, r.chunks, r.skipped, r.rejected, "doc_id")
    listed = r.skipped.groupBy("doc_id").agg(F.count_distinct("chunk_id").alias("listed"))
    report = evaluate.report(r.chunks.select("doc_id", "chunk_id"), kept, listed)
    totals = insights.counts(kept.withColumn("data_source", F.try_variant_get("a", F.lit("$.data_source"), "string")), "doc_id")
    summary = insights.confidence_tiers(insights.quality(totals)).withColumn("recommendations", insights.recommendations())
    return replace(r, metadata=metadata, report=report, insights=summary)


def second_pass(first: Run, blocks: DataFrame, extractor: Extractor = deterministic, **options) -> Run:
    """The documents whose report asks for another try, read again with the second prompt; the others stay as they are."""
    again = durable(first.report.where("is_retryable").select("doc_id"))
    if not again.limit(1).count():
        return first
    part = run(blocks.join(again, "doc_id", "left_semi"), extractor, iteration=2, **options)
    mixed = lambda a, b: a.join(again, "doc_id", "left_anti").unionByName(b, allowMissingColumns=True)
    return _summed(replace(first, requirements=mixed(first.requirements, part.requirements), rejected=mixed(first.rejected, part.rejected), skipped=mixed(first.skipped, part.skipped), prompts=mixed(first.prompts, part.prompts)))
