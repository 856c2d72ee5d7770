"""Queries over the driver's tables, one per operator or group of operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import error_class
from ..functions import attributes as at
from ..functions import control, grounding, ids, repair, score, text, verbs
from ..operators import atomize, chunking, components, dedup, discovery, evaluate, gate, insights
from ..sources import prompts, sinks
from ..streaming import ingest
from . import views

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(f: Query) -> Query:
    REGISTRY[f.__name__] = f
    return f


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def view(spark: SparkSession, d: str, sql: str) -> DataFrame:
    """A shared SQL view over the tables that it names."""
    for name in views.TABLES:
        if f" {name}" in sql:
            table(spark, d, name).createOrReplaceTempView(name)
    return spark.sql(sql)


def spread(df: DataFrame) -> DataFrame:
    """A scan of fewer partitions than cores, dealt out before the work per row; larger scans are left alone."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def reqs(spark: SparkSession, d: str, sql: str = views.REQUIREMENTS) -> DataFrame:
    spread(table(spark, d, "orders").select("o_orderkey")).createOrReplaceTempView("orders")
    return spark.sql(sql).withColumn("a", F.try_parse_json("attributes"))


# -- text and ids


@query
def normalize_text(spark, d):
    x = text.normalize_text(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.length(x).alias("n"), F.sha2(x, 256).alias("sha"))


@query
def page_counters(spark, d):
    raw = F.concat(F.when(F.col("o_orderkey") % 3 == 0, F.lit("  Page ")).otherwise(F.lit("Pages ")), F.col("o_orderkey").cast("string"), F.lit(" of 900  \n\n\n\n"))
    return table(spark, d, "orders").select("o_orderkey", text.clean_paragraph(raw).alias("line"))


@query
def chunk_ids(spark, d):
    return table(spark, d, "documents").select("doc_id", ids.chunk_id(F.col("source"), F.col("doc_id"), F.col("text")).alias("chunk_id"))


@query
def requirement_ids(spark, d):
    return reqs(spark, d).select("k", ids.requirement_id(F.col("rule_type"), F.col("rule_description"), F.col("grounded_in")).alias("requirement_id"))


@query
def heading_entities(spark, d):
    heading = F.concat(F.element_at(F.array(F.lit("P-"), F.lit("r-"), F.lit("C-"), F.lit("X-")), (F.col("p_partkey") % 4 + 1).cast("int")), F.lpad(F.col("p_partkey").cast("string"), 3, "0"), F.lit(": "), F.col("p_name"))
    e = chunking.heading_entity(heading)
    return table(spark, d, "part").select("p_partkey", e["record_type"].alias("record_type"), e["record_id"].alias("record_id"))


# -- chunking


@query
def chunk_prose(spark, d):
    lines = chunking.line_blocks(table(spark, d, "documents"))
    out = chunking.pack_blocks(lines, 1000)
    return out.select("doc_id", "position", F.length("content_text").alias("n"), F.sha2("content_text", 256).alias("sha"))


@query
def build_batches(spark, d):
    return chunking.build_batches(view(spark, d, views.CHUNKS)).select("doc_id", "batch_id", "ord", "pos")


@query
def split_tables(spark, d):
    rows = table(spark, d, "lineitem").withColumn("r", F.array(F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"), F.col("l_returnflag")))
    rows = rows.groupBy("l_suppkey").agg(F.sort_array(F.collect_list(F.struct("l_orderkey", "l_linenumber", "r"))).alias("x"))
    t = F.concat(F.array(F.array(F.lit("Line"), F.lit("Part"), F.lit("Flag"))), F.transform("x", lambda y: y["r"]))
    parts = rows.select("l_suppkey", F.posexplode(chunking.split_table(t, 400)).alias("part", "p"))
    return parts.select("l_suppkey", "part", F.col("p.start").alias("first_row"), F.col("p.end").alias("last_row"), F.length(chunking.table_text(F.col("p.table"))).alias("n"))


@query
def document_chunks(spark, d):
    """The block state machine over lines dressed as headings, lists, prose and tables."""
    lines = chunking.line_blocks(table(spark, d, "documents"))
    n = F.col("pos")
    blocks = lines.select(
        F.col("doc_id").cast("string").alias("doc_id"), n.cast("int").alias("block_idx"), F.when(n % 11 == 10, "table").otherwise("paragraph").alias("kind"),
        F.when(n % 7 == 1, "Heading 1").when(n % 5 == 0, "List Bullet").otherwise("Normal").alias("style"), (n % 13 == 3).alias("has_numpr"), "text",
        F.when(n % 11 == 10, F.array(F.array(F.lit("Policy ID"), F.concat(F.lit("P-"), F.col("doc_id").cast("string"))), F.array(F.lit("Text"), F.col("text")))).alias("table_data"),
    )
    chunks, _ = chunking.chunk_blocks(blocks, 1000, 50)
    return chunks.select("doc_id", "position", "chunk_id", "chunk_type", "source_location", "char_count", "annotations.record_id", "annotations.fragment_warning")


@query
def document_stats(spark, d):
    """Sections, characters and skips when every line is a paragraph."""
    lines = chunking.line_blocks(table(spark, d, "documents"))
    blocks = lines.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("pos").cast("int").alias("block_idx"), F.lit("paragraph").alias("kind"), F.lit("Normal").alias("style"), F.lit(False).alias("has_numpr"), "text", F.lit(None).cast("array<array<string>>").alias("table_data"))
    return chunking.chunk_blocks(blocks, 20, 15)[1]


# -- discovery and gate


@query
def stratified_sample(spark, d):
    return discovery.stratified_sample(view(spark, d, views.CHUNKS)).select("doc_id", "position", "stratum")


@query
def entity_stats(spark, d):
    out = discovery.entity_stats(view(spark, d, views.CHUNKS), "doc_id")
    return out.withColumn("record_ids", F.array_join("record_ids", ","))


@query
def field_labels(spark, d):
    t = table(spark, d, "supplier").select(
        (F.col("s_nationkey") % 5).cast("string").alias("doc_id"), F.when(F.col("s_suppkey") % 4 != 0, "risk").alias("record_type"), F.col("s_suppkey").alias("position"),
        F.when(F.col("s_suppkey") % 2 == 0, 2).otherwise(3).alias("col_count"),
        F.when(F.col("s_suppkey") % 2 == 0, F.array(F.array(F.lit("Risk ID"), F.col("s_name")), F.array(F.concat(F.lit(" Owner "), (F.col("s_suppkey") % 3).cast("string")), F.lit(" x "))))
        .otherwise(F.array(F.array(F.lit("Name"), F.lit(""), F.lit("Nation")), F.array(F.col("s_name"), F.lit("y"), F.col("s_nationkey").cast("string")))).alias("table_data"),
    )
    return discovery.field_labels(t)


@query
def schema_avg_confidence(spark, d):
    fields = reqs(spark, d, views.SCORED).withColumn("entity", F.col("doc_id"))
    return discovery.avg_confidence(fields, "confidence", "entity")


def _gate_input(spark, d):
    c = table(spark, d, "customer")
    fmt = F.element_at(F.array(*[F.lit(x) for x in ("grc_export", "regulatory_docx", "data_dictionary", "docx")]), (F.col("c_custkey") % 4 + 1).cast("int"))
    return c.select("c_custkey", fmt.alias("document_format"), F.when(F.col("c_custkey") % 50 != 0, (F.col("c_custkey") % 100) / 100).alias("avg_confidence"))


@query
def gate_decisions(spark, d):
    out = gate.decide(_gate_input(spark, d))
    return out.select("c_custkey", "decision", F.array_join("failing_checks", "; ").alias("failing"), F.size("conditional_flags").alias("flags"), "rationale")


@query
def gate_after_evaluation(spark, d):
    k = F.col("c_custkey")
    df = _gate_input(spark, d).withColumns({"total_requirements": k % 9, "schema_issues": k % 5, "coverage_ratio": (k % 11) / 10, "testability_issues": k % 2, "hallucination_flags": k % 3})
    out = gate.decide(df)
    return out.select("c_custkey", "decision", F.array_join("failing_checks", "; ").alias("failing"), F.array_join("conditional_flags", "; ").alias("flags"))


# -- components


def _components(spark, d):
    c = view(spark, d, views.COMPONENTS)
    return c.withColumns({x: components.split_list(F.col(x)) for x in components.RELATIONS})


@query
def component_edges(spark, d):
    return components.edges(_components(spark, d)).select("src", "relation", "dst")


@query
def missing_references(spark, d):
    return components.missing_references(_components(spark, d)).select("src", "relation", "dst", "message")


@query
def reference_index(spark, d):
    return components.reference_index(_components(spark, d)).withColumn("refs", F.array_join("refs", ","))


@query
def component_chunk_index(spark, d):
    return components.chunk_index(_components(spark, d))


@query
def component_summary(spark, d):
    return components.summary(_components(spark, d))


@query
def control_type_parts(spark, d):
    p = table(spark, d, "part")
    x = components.control_type(F.regexp_replace("p_type", " ", " / "))
    return p.select("p_partkey", x["raw"].alias("raw"), x["nature"].alias("nature"), x["automation"].alias("automation"))


# -- atomizing


@query
def parent_link(spark, d):
    """The components are those of one document, which all requirements are taken to be of."""
    index = components.chunk_index(_components(spark, d).withColumn("doc_id", F.lit("all")), "doc_id")
    return atomize.parent_link(reqs(spark, d).withColumn("doc_id", F.lit("all")), index).select("k", "parent_component_id")


@query
def response_items(spark, d):
    """JSON responses, some fenced, some broken, parsed to items."""
    k = F.col("k")
    item = F.concat(F.lit('{"rule_type":"'), F.col("rule_type"), F.lit('","rule_description":"'), F.col("rule_description"), F.lit('","confidence":0.9}'))
    content = F.when(k % 5 == 0, F.concat(F.lit("```json\n["), item, F.lit("]\n```"))).when(k % 5 == 1, item).when(k % 5 == 2, F.lit("no json")).otherwise(F.concat(F.lit("["), item, F.lit(","), item, F.lit("]")))
    r = reqs(spark, d).select("doc_id", k.alias("batch_id"), content.alias("content"))
    items, _ = atomize.parse_items(r)
    return items.select("batch_id", "item_ord", at.field(F.col("item"), "rule_type").alias("rule_type"), at.field(F.col("item"), "confidence", "double").alias("confidence"))


@query
def response_status(spark, d):
    k = F.col("k")
    content = F.when(k % 3 == 0, F.lit("[]")).when(k % 3 == 1, F.lit("[1, ")).otherwise(F.lit("```\n[1,2]\n```"))
    return atomize.parse_items(reqs(spark, d).select("doc_id", k.alias("batch_id"), content.alias("content")))[1].select("batch_id", "n_items", "parse_error")


@query
def validate_attributes(spark, d):
    m = at.missing_fields(F.col("a"), F.col("rule_type"))
    return reqs(spark, d).select("k", F.array_join(m, ", ").alias("missing"), (F.size(m) == 0).alias("valid"))


@query
def repair_attributes(spark, d):
    r = repair.with_repair(reqs(spark, d))
    a = F.col("a")
    names = ("applies_to", "threshold_direction", "threshold_unit", "metric", "requirement", "ownership_type", "applies_when", "control_type", "threshold_value", "data_source")
    return r.select("k", "schema_status", F.array_join("missing_fields", ", ").alias("missing"), *[at.field(a, x).alias(x) for x in names])


@query
def applicable_fields(spark, d):
    return reqs(spark, d).select("k", F.array_join(repair.applicable_fields(F.col("rule_description")), ",").alias("fields"))


@query
def data_sources(spark, d):
    return reqs(spark, d).select("k", repair.data_source(F.col("rule_description"), F.col("rule_type")).alias("data_source"))


@query
def fragment_flags(spark, d):
    out = atomize.with_fragment(reqs(spark, d))
    return out.select("k", F.col("fragment_warning").alias("requirement_fragment"), chunking.is_fragment(F.col("rule_description")).alias("chunk_fragment"))


@query
def extraction_metadata(spark, d):
    """Of documents that keep a requirement; a requirement row stands for a chunk."""
    r = reqs(spark, d, views.SCORED)
    kept = r.where("grounding_classification <> 'INFERENCE'").where(F.col("confidence") >= atomize.pass_threshold(F.col("extraction_iteration")))
    none = r.limit(0).select("doc_id", F.lit("").alias("chunk_id"))
    out = atomize.extraction_metadata(kept, r, none, r.where("grounding_classification = 'INFERENCE'"), "doc_id")
    return out.where("total_requirements_extracted > 0").select("doc_id", F.col("total_requirements_extracted").alias("n"), "avg_confidence", F.col("inference_rejected_count").alias("rejected"))


@query
def dedup_leaders(spark, d):
    r = reqs(spark, d, views.SCORED).withColumn("_scope", F.concat_ws("|", "doc_id", "rule_type"))
    return dedup.leaders(r, "req_no", "_scope", "confidence", text.content_tokens(F.col("rule_description"))).drop("_scope")


@query
def duplicate_pairs(spark, d):
    return evaluate.duplicates(reqs(spark, d)).select("a", "b", "similarity")


@query
def dedup_ratios(spark, d):
    r = reqs(spark, d)
    pairs = evaluate.duplicate_counts(r).withColumnRenamed("duplicate_pairs", "pairs")
    n = r.groupBy("doc_id").agg(F.count("*").alias("n")).join(pairs, "doc_id", "left").fillna(0, ["pairs"])
    return n.select("doc_id", "n", "pairs", F.round(dedup.dedup_ratio(F.col("n"), F.col("pairs")), 6).alias("dedup_ratio"))


# -- scoring


@query
def token_jaccard(spark, d):
    x, y = text.score_tokens(F.col("rule_description")), text.score_tokens(F.col("grounded_in"))
    return view(spark, d, views.PAIRS).select("conv_id", "turn", F.size(x).alias("d"), F.size(y).alias("g"), text.half_up(grounding.jaccard(x, y), 3).alias("jaccard"))


@query
def phrase_matches(spark, d):
    p = score.with_evidence(view(spark, d, views.PAIRS))
    return p.select("conv_id", "turn", "phrase_count", F.array_join(F.sort_array("matched_phrases"), "|").alias("phrases"))


@query
def grounding_class(spark, d):
    """Flagship: grounding of each assistant turn in the user turn before it."""
    p = score.with_evidence(view(spark, d, views.PAIRS))
    c = grounding.classify(F.col("grounding_match"), F.col("jaccard_score"), F.col("phrase_count"))
    return p.select("conv_id", "turn", "jaccard_score", "phrase_count", "grounding_match", c.alias("grounding_class"))


@query
def grounding_older_profile(spark, d):
    p = score.with_evidence(view(spark, d, views.PAIRS), profile=grounding.OLDER)
    return p.select("conv_id", "turn", "grounding_match", grounding.classify_older(F.col("grounding_match")).alias("grounding_class"))


@query
def completeness(spark, d):
    return reqs(spark, d).select("k", at.completeness(F.col("a"), F.col("rule_type")).alias("completeness"), at.completeness(F.col("a"), F.col("rule_type"), grounding.OLDER).alias("older"))


@query
def quantification(spark, d):
    return reqs(spark, d).select("k", at.quantification(F.col("a"), F.col("rule_description")).alias("quantification"))


@query
def canonical_validation(spark, d):
    a, t = F.col("a"), F.col("rule_type")
    return reqs(spark, d).select("k", F.array_join(at.canonical_errors(a, t), ", ").alias("errors"), F.array_join(at.canonical_warnings(a, t), ", ").alias("warnings"), at.compliance(a, t).alias("compliance"))


@query
def coherence(spark, d):
    return reqs(spark, d).select("k", grounding.coherence(F.col("rule_description"), F.col("grounded_in")).alias("coherence"))


@query
def domain_signals(spark, d):
    x, y = F.col("rule_description"), F.col("grounded_in")
    return reqs(spark, d).select("k", grounding.domain_signals(x, y).alias("domain_signals"), grounding.domain_signals(x, y, grounding.OLDER).alias("older"))


@query
def confidence_score(spark, d):
    s = score.with_confidence(reqs(spark, d))
    return s.select("k", "grounding_match", "raw_total", "confidence", "grounding_classification", "requires_review", "rationale")


# -- verbs and control metadata


@query
def verb_context(spark, d):
    return reqs(spark, d).select("k", verbs.context(F.col("rule_description")).alias("context"))


@query
def vague_verbs(spark, d):
    return reqs(spark, d).select("k", verbs.base_verb_count(F.col("rule_description")).cast("int").alias("n"), verbs.has_base_verb(F.col("rule_description")).alias("vague"))


@query
def verb_templates(spark, d):
    v = verbs.template_values(F.col("rule_description"))
    return reqs(spark, d).select("k", *[c.alias(n) for n, c in v.items()])


@query
def verb_replacement(spark, d):
    r = reqs(spark, d).withColumn("v", verbs.replace_vague(F.col("rule_description")))
    return r.select("k", "v.replaced", F.size("v.replacements").alias("n"), "v.has_vague_verbs")


@query
def control_objectives(spark, d):
    return reqs(spark, d).select("k", control.objective(F.col("a"), F.col("rule_type")).alias("objective"))


@query
def control_risks(spark, d):
    return reqs(spark, d).select("k", F.array_join(control.risks(F.col("rule_type"), F.col("rule_description")), ",").alias("risks"))


@query
def control_types(spark, d):
    return reqs(spark, d).select("k", control.control_type(F.col("rule_type"), F.col("rule_description")).alias("control_type"), control.measurement_type(F.col("a"), F.col("rule_type")).alias("measurement_type"))


@query
def test_procedures(spark, d):
    return reqs(spark, d).select("k", F.sha2(control.test_procedure(F.col("a"), F.col("rule_type"), F.col("rule_description")), 256).alias("sha"))


@query
def control_owners(spark, d):
    return reqs(spark, d).select("k", control.owner(F.col("a"), F.col("rule_type")).alias("owner"), control.automation(F.col("rule_description")).alias("automation"))


@query
def evidence_types(spark, d):
    return reqs(spark, d).select("k", F.array_join(control.evidence(F.col("rule_type")), ";").alias("evidence"))


@query
def system_mapping(spark, d):
    s = control.systems(F.col("rule_description"))
    return reqs(spark, d).select("k", F.array_join(s["systems"], ",").alias("systems"), s["source"].alias("source"), F.array_join(s["keywords"], ",").alias("keywords"))


@query
def exception_tiers(spark, d):
    t = control.exception_tiers(F.col("a"), F.col("rule_type"))
    r = reqs(spark, d).select("k", F.explode(t).alias("tier", "x"))
    return r.select("k", "tier", "x.condition", "x.sla_remediation")


@query
def automation_breakdown(spark, d):
    r = reqs(spark, d).withColumn("control_metadata", F.struct(control.automation(F.col("rule_description")).alias("automated")))
    return insights.automation(r, "doc_id")


# -- evaluation


def _chunk_rows(spark, d):
    return table(spark, d, "documents").select(F.concat(F.lit("c-"), F.col("doc_id").cast("string")).alias("chunk_id"), "source")


@query
def coverage(spark, d):
    chunks = _chunk_rows(spark, d).withColumn("scope", F.lit("all"))
    out = evaluate.coverage(chunks, reqs(spark, d).withColumn("scope", F.lit("all")), "scope")
    return out.select("total_chunks", "chunks_processed", F.round("coverage_ratio", 6).alias("coverage_ratio"))


@query
def zero_chunks(spark, d):
    return evaluate.zero_chunks(_chunk_rows(spark, d), reqs(spark, d)).select("chunk_id")


@query
def unlabelled_documents(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id").distinct(), "doc_id", "left_anti").select("doc_id")


@query
def testability_issues(spark, d):
    return evaluate.testability(reqs(spark, d)).select("k", F.array_join("issues", "; ").alias("issues"), "severity")


@query
def grounding_issues(spark, d):
    return evaluate.grounding(reqs(spark, d, views.SCORED)).select("k", F.array_join("issues", "; ").alias("issues"), "severity")


@query
def hallucination_flags(spark, d):
    return evaluate.hallucination(reqs(spark, d, views.SCORED)).select("k", F.array_join("flags", "; ").alias("flags"), "risk")


@query
def schema_compliance_issues(spark, d):
    return evaluate.schema_compliance(reqs(spark, d)).select("k", F.array_join("missing_fields", ", ").alias("missing"), F.size("invalid_fields").alias("invalid"), "severity")


@query
def enrichment_issues(spark, d):
    r = reqs(spark, d, views.SCORED).withColumns({"raw_total": F.col("confidence") + (F.col("k") % 4) / 50, "requirement_id": F.col("k"), "control_metadata": control.metadata(F.col("a"), F.col("rule_type"), F.col("rule_description"))})
    return evaluate.enrichment_issues(r).select(F.col("requirement_id").alias("k"), "issue_type", "detail")


@query
def confidence_histogram(spark, d):
    return evaluate.confidence_distribution(reqs(spark, d, views.SCORED), "doc_id")


@query
def requirements_by_type(spark, d):
    return evaluate.by_type(reqs(spark, d), "doc_id")


@query
def schema_coverage(spark, d):
    r = reqs(spark, d)
    labels = r.select("doc_id").distinct().withColumn("entity", F.explode(F.array(F.lit("ACCOUNT"), F.lit("Vendor"), F.lit("percent"), F.lit("nothing"))))
    return evaluate.schema_coverage(r, labels)


def _counts(spark, d):
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(
        k, ((k % 101) / 100).alias("coverage_ratio"), (k % 8).alias("testability_issues"), (k % 6).alias("grounding_issues"), (k % 9).alias("schema_issues"), (k % 5).alias("schema_high"),
        ((k % 37) / 36).alias("dedup_ratio"), (k % 10).alias("hallucination_flags"), (F.when(k % 4 == 0, k % 3).otherwise(0)).alias("hallucination_critical"), (k % 6).alias("hallucination_high"),
        (k % 2 + 1).alias("extraction_iteration"), ((50 + k % 50) / 100).alias("avg_confidence"), (k % 21).alias("total_requirements"),
        F.when(k % 2 == 0, F.array(F.lit("scope"), F.lit("applies_to"))).otherwise(F.array().cast("array<string>")).alias("missing_names"),
    )


@query
def failure_classes(spark, d):
    return evaluate.classify(_counts(spark, d)).select("c_custkey", "failure_type", "failure_severity", "is_retryable")


@query
def quality_scores(spark, d):
    return _counts(spark, d).select("c_custkey", evaluate.quality_score().alias("score"))


@query
def suggestions(spark, d):
    return _counts(spark, d).select("c_custkey", F.array_join(evaluate.suggestions(), " / ").alias("suggestions"))


@query
def evaluation_report(spark, d):
    """All checks of each document in one row."""
    chunks = view(spark, d, views.REQUIREMENTS).select("doc_id", F.col("source_chunk_id").alias("chunk_id")).distinct()
    out = evaluate.report(chunks, reqs(spark, d, views.SCORED))
    return out.select("doc_id", "total_chunks", "chunks_processed", "total_requirements", "testability_issues", "grounding_issues", "schema_issues", "hallucination_flags", "duplicate_pairs", "failure_type", "failure_severity", "is_retryable")


# -- insights and views


@query
def insights_quality(spark, d):
    c = insights.quality(insights.counts(reqs(spark, d, views.SCORED), "doc_id"))
    return c.select("doc_id", "schema_completeness_pct", "grounding_quality_pct", "data_source_coverage_pct", "overall_quality_tier")


@query
def insights_risk_flags(spark, d):
    return insights.risk_flags(insights.counts(reqs(spark, d, views.SCORED), "doc_id"), "doc_id").select("doc_id", "severity", "issue", "detail", "n")


@query
def rule_type_shares(spark, d):
    return insights.rule_type_shares(reqs(spark, d), "doc_id")


@query
def confidence_tiers(spark, d):
    c = insights.confidence_tiers(insights.counts(reqs(spark, d, views.SCORED), "doc_id"))
    return c.select("doc_id", "high", "medium", "low", "high_pct", "medium_pct", "low_pct", "average_confidence")


@query
def hallucination_risk(spark, d):
    r = reqs(spark, d, views.SCORED)
    out = insights.hallucination_risk(evaluate.hallucination(r), r.groupBy("doc_id").agg(F.count("*").alias("total")), "doc_id")
    return out.select("doc_id", "hallucination_count", "critical_count", "high_count", "hallucination_pct")


@query
def recommendations(spark, d):
    c = insights.counts(reqs(spark, d, views.SCORED), "doc_id")
    return c.select("doc_id", F.array_join(insights.recommendations(), " / ").alias("recommendations"))


@query
def dashboard_filter(spark, d):
    return insights.filtered(reqs(spark, d, views.SCORED), None, "Medium", "DEPOSIT").select("k", "rule_type", "confidence")


@query
def dashboard_page(spark, d):
    return insights.page(reqs(spark, d, views.SCORED), 3, 20, key="k").select("k", "confidence")


@query
def attribute_column(spark, d):
    r = reqs(spark, d)
    return r.select("k", insights.attribute_summary(repair.applicable_fields(F.col("rule_description")), at.field(F.col("a"), "data_source"), at.field(F.col("a"), "control_type")).alias("attribute"))


@query
def export_rows(spark, d):
    r = reqs(spark, d, views.SCORED).withColumns({"requirement_id": F.col("k").cast("string"), "applicable_fields": repair.applicable_fields(F.col("rule_description")), "control_type": at.field(F.col("a"), "control_type")})
    out = insights.export_rows(r)
    return out.select(*[F.col(f"`{c}`").alias(c.lower().replace(" ", "_")) for c in out.columns])


# -- what surrounds the flow


@query
def extractable_chunks(spark, d):
    return prompts.extractable(view(spark, d, views.CHUNKS)).groupBy("doc_id", "record_type").agg(F.count("*").alias("n"))


@query
def schema_hashes(spark, d):
    return table(spark, d, "part").select("p_partkey", ids.schema_hash(F.concat_ws("|", "p_name", "p_brand", "p_type")).alias("schema_version"))


@query
def reconciled_coverage(spark, d):
    k = F.col("c_custkey")
    ratio, zero, listed, total = (k % 101) / 100, k % 7, k % 11, k % 13
    return table(spark, d, "customer").select(k, F.round(evaluate.reconciled(ratio, zero, listed, total), 6).alias("coverage_ratio"))


@query
def canonical_normalized(spark, d):
    m = at.canonical_normalized(F.col("a"), F.col("rule_type"))
    return reqs(spark, d).select("k", F.element_at(m, "metric_type").alias("metric_type"), F.element_at(m, "timeline_value").alias("timeline_value"), F.element_at(m, "scope").alias("scope"), F.coalesce(F.size(m), F.lit(-1)).alias("n"))


@query
def metadata_complete(spark, d):
    r = reqs(spark, d).withColumn("m", control.metadata(F.col("a"), F.col("rule_type"), F.col("rule_description")))
    return r.groupBy("rule_type").agg(F.count_if(control.is_complete("m")).alias("complete"), F.count("*").alias("n"))


@query
def skip_records(spark, d):
    """Batches that gave nothing: no response, a broken one, or an empty one."""
    r = reqs(spark, d)
    k = F.col("k")
    members = r.select("doc_id", k.alias("batch_id"), F.lit(0).alias("ord"), F.col("source_chunk_id").alias("chunk_id"), F.lit("").alias("source_location"))
    content = F.when(k % 4 == 1, F.lit("[1, ")).when(k % 4 == 2, F.lit("[]")).otherwise(F.concat(F.lit('[{"rule_type":"'), F.col("rule_type"), F.lit('"}]')))
    items, status = atomize.parse_items(r.where(k % 4 != 3).select("doc_id", k.alias("batch_id"), content.alias("content")))
    return atomize.skipped(members, status, atomize.requirements(items, members)).groupBy("skip_reason").agg(F.count("*").alias("n"), F.count_distinct("chunk_id").alias("chunks"))


@query
def error_classes(spark, d):
    k = F.col("event_id")
    said = F.element_at(F.array(*[F.lit(x) for x in ("HTTP 529 Overloaded", "status 429", "403 forbidden", "cannot parse JSON", "connection reset", "boom")]), (k % 6 + 1).cast("int"))
    e = error_class(said)
    return table(spark, d, "events").groupBy(e["error_type"].alias("error_type"), e["is_retryable"].alias("is_retryable")).agg(F.count("*").alias("n"))


@query
def manifest_entries(spark, d):
    k = F.col("o_orderkey")
    name = F.concat(F.lit("requirements_Part_"), k.cast("string"), F.when(k % 3 != 0, F.concat(F.lit("_"), F.date_format("o_orderdate", "yyyyMMdd_HHmmss"), F.lit("_1b9e96d0"))).otherwise(""), F.lit(".json"))
    m = sinks.manifest_entry(name)
    return table(spark, d, "orders").select(k, m["label"].alias("label"), m["timestamp"].alias("timestamp"))


@query
def upsert_latest(spark, d):
    r = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("requirement_id"), F.col("c_mktsegment").alias("v"))
    new = r.select((F.col("requirement_id").cast("long") + 100).cast("string").alias("requirement_id"), F.lit("new").alias("v"))
    return sinks.latest(r, new)


@query
def event_windows(spark, d):
    return ingest.event_counts(table(spark, d, "events"))


@query
def published_json(spark, d):
    """The published form of requirements that passed all steps."""
    r = reqs(spark, d).withColumns({"requirement_id": F.col("k").cast("string"), "source_location": F.lit("block 1"), "model_confidence": F.lit(0.7)})
    kept, _ = atomize.validate_and_adjust(r, known=atomize.known_texts(r))
    out = text.settled(kept.select("k", sinks.output_json(kept).alias("j")))
    return out.select("k", F.length("j").alias("n"), F.from_json("j", "rule_type string").getField("rule_type").alias("rule_type"))


def queries() -> dict[str, Query]:
    return dict(REGISTRY)
