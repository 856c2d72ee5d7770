"""Quality checks of requirements, failure classification, report.

Requirements have doc_id, requirement_id, rule_type, rule_description, grounded_in,
confidence, extraction_iteration, source_chunk_id, a (VARIANT),
grounding_match and grounding_classification. Every check is a narrow
transform that keeps the rows with issues; counts meet as one row per document.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

from ahocorasick import Automaton
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dims
from ..functions import attributes as at
from ..functions.text import blank_tokens, contains_any, fixed, settled
from .chunking import folded
from .dedup import dedup_ratio, pair_counts, similar_pairs


def some(*tests: Column) -> Column:
    """The texts of those that hold."""
    return F.filter(F.array(*tests), lambda x: x.isNotNull())


def two(x: Column) -> Column:
    """Two decimals, as text."""
    return fixed(x, 2)


def coverage(chunks: DataFrame, reqs: DataFrame, *keys: str) -> DataFrame:
    """total_chunks, chunks_processed, coverage_ratio per key; ids that are no chunk's still count as processed."""
    total = chunks.groupBy(*keys).agg(F.count("*").alias("total_chunks"))
    used = reqs.where(F.coalesce("source_chunk_id", F.lit("")) != "").groupBy(*keys).agg(F.count_distinct("source_chunk_id").alias("chunks_processed"))
    out = total.join(used, list(keys), "left").fillna(0, ["chunks_processed"])
    return out.withColumn("coverage_ratio", F.col("chunks_processed") / F.col("total_chunks"))


def zero_chunks(chunks: DataFrame, reqs: DataFrame, *keys: str) -> DataFrame:
    """Chunks without a requirement."""
    used = reqs.select(*keys, F.col("source_chunk_id").alias("chunk_id")).distinct()
    return chunks.join(used, [*keys, "chunk_id"], "left_anti")


def reconciled(ratio: Column, zero: Column, listed: Column, total: Column) -> Column:
    """The coverage ratio, by the extraction's own list of empty chunks where that is longer."""
    return F.when((listed > zero) & (total > 0), 1 - listed / F.greatest(total, F.lit(1))).otherwise(ratio)


def testability(reqs: DataFrame) -> DataFrame:
    out = settled(reqs.withColumn("issues", testability_issues())).where(F.size("issues") > 0)
    return out.withColumn("severity", F.when(F.size("issues") > 1, "high").otherwise("medium"))


def testability_issues() -> Column:
    """Texts of what keeps a requirement from being tested; only the fields that its type needs are read."""
    a, kind, low = F.col("a"), F.col("rule_type"), F.lower(F.coalesce("rule_description", F.lit("")))
    no = lambda *names: ~_any([at.truthy(a, n) for n in names])
    return some(
        F.when(kind == "unknown", "rule_type not mapped"),
        F.when((kind == "data_quality_threshold") & no("threshold_value", "metric_type", "metric"), "missing metric definition"),
        F.when((kind == "data_quality_threshold") & no("threshold_value"), "missing threshold_value (cannot test)"),
        F.when((kind == "documentation_requirement") & no("document_type", "documentation_type"), "missing documentation_type"),
        F.when((kind == "documentation_requirement") & no("required_by", "applies_when"), "missing trigger condition (applies_when)"),
        F.when((kind == "update_timeline") & no("timeline_value", "threshold_value"), "missing timeline value"),
        F.when((kind == "update_requirement") & no("update_frequency", "applies_when"), "missing update frequency"),
        F.when((kind == "beneficial_ownership_threshold") & no("threshold_value"), "missing ownership threshold value"),
        F.when(low.startswith("a ") & F.contains(low, F.lit(" means ")), "appears to be a definition, not an obligation"),
        F.when(low.startswith("the term "), "appears to be a definition, not an obligation"),
        F.when(contains_any(low, dims.VAGUE_WORDS) & ~low.rlike(r"\p{Nd}"), "vague language without quantification"),
    )


def _any(tests: list[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def grounding(reqs: DataFrame) -> DataFrame:
    out = reqs.withColumn("issues", grounding_issues()).where(F.size("issues") > 0)
    return out.withColumn("severity", F.when(_uncited() | (F.col("confidence") < 0.60), "high").otherwise("medium"))


def _uncited() -> Column:
    return F.trim(F.coalesce("grounded_in", F.lit(""))) == ""


def grounding_issues() -> Column:
    conf, it, match = F.col("confidence"), F.col("extraction_iteration"), F.coalesce("grounding_match", F.lit(0.0))
    return some(
        F.when(_uncited(), "missing grounded_in citation"),
        F.when(F.col("grounding_classification") == "INFERENCE", "grounding classified as INFERENCE (weak source match)"),
        F.when(match < 0.10, F.concat(F.lit("very low grounding match ("), two(match), F.lit(")"))),
        F.when((it == 1) & (conf < 0.70), F.concat(F.lit("low confidence ("), two(conf), F.lit(") on first iteration"))),
        F.when((it >= 2) & (conf < 0.75), F.concat(F.lit("low confidence ("), two(conf), F.lit(") on retry iteration "), it.cast("string"))),
    )

def hallucination(reqs: DataFrame) -> DataFrame:
    flags, risk = hallucination_flags()
    return reqs.withColumns({"flags": flags, "risk": risk}).where(F.size("flags") > 0)


def hallucination_flags() -> tuple[Column, Column]:
    """Texts of the flags, and the risk."""
    conf, it = F.col("confidence"), F.col("extraction_iteration")
    first, again = it == 1, it >= 2
    say = lambda a, b="": F.concat(F.lit(a), two(conf), F.lit(b))
    flag = (
        F.when(first & (conf < 0.60), say("Confidence ", " critically low on first pass"))
        .when(first & (conf < 0.70), say("Confidence ", " below safe threshold on first pass"))
        .when(first & (conf < 0.80), say("Moderate inference (", "); recommend human review"))
        .when(again & (conf < 0.70), say("Retry pass: confidence ", " critically low"))
        .when(again & (conf < 0.75), say("Retry pass: confidence ", " still below retry threshold (0.75)"))
        .when(again & (conf < 0.85), say("Retry pass: moderate inference (", "); borderline"))
    )
    risk = (
        F.when((first & (conf < 0.60)) | (again & (conf < 0.70)), "critical").when((first & (conf < 0.70)) | (again & (conf < 0.75)), "high")
        .when((first & (conf < 0.80)) | (again & (conf < 0.85)), "medium").otherwise("low")
    )
    inferred = F.col("grounding_classification") == "INFERENCE"
    flags = some(flag, F.when(inferred, "Grounding classified as INFERENCE (potential fabrication)"))
    return flags, F.when(inferred & (risk == "low"), "medium").otherwise(risk)


def schema_compliance(reqs: DataFrame) -> DataFrame:
    """Canonical fields that are missing; types without a canonical schema are left out."""
    a, kind = F.col("a"), F.col("rule_type")
    out = reqs.withColumns({"missing_fields": at.canonical_errors(a, kind), "invalid_fields": at.canonical_warnings(a, kind)}).where(F.size("missing_fields") > 0)
    return out.withColumn("severity", F.when(F.size("missing_fields") >= 2, "high").otherwise("medium"))


def duplicates(reqs: DataFrame, key: str = "req_no", scope: str = "_scope", threshold: float = dims.DUPLICATE_SIMILARITY) -> DataFrame:
    """Pairs of requirements of one document and type with similar words; the key must be ordered and unique in its document."""
    scoped = reqs.withColumn(scope, F.concat_ws("|", "doc_id", "rule_type"))
    return similar_pairs(scoped, key, scope, blank_tokens(F.col("rule_description")), threshold)


def duplicate_counts(reqs: DataFrame, key: str = "req_no", threshold: float = dims.DUPLICATE_SIMILARITY) -> DataFrame:
    """(doc_id, duplicate_pairs): the number of those pairs, without making them. Equal texts are counted before they are cut into words."""
    scope = F.concat_ws("|", "doc_id", "rule_type").alias("_scope")
    texts = reqs.groupBy(scope, "rule_description").agg(F.min(key).alias(key), F.count("*").alias("_n"))
    counts = pair_counts(texts, key, "_scope", blank_tokens(F.col("rule_description")), threshold, F.col("_n"))
    return counts.groupBy(F.regexp_replace("_scope", r"\|[^|]*$", "").alias("doc_id")).agg(F.sum("pairs").alias("duplicate_pairs"))


def enrichment_issues(reqs: DataFrame) -> DataFrame:
    """(requirement_id, issue_type, detail): scores that do not add up, template slips, unfounded mappings. Needs control_metadata and raw_total."""
    m = "control_metadata"
    expected = F.least(F.lit(0.99), F.greatest(F.lit(0.50), F.col("raw_total")))
    doubled = F.regexp_extract(F.coalesce(f"{m}.control_objective", F.lit("")), r"(?iU)\b(\w++)\s+\1\b", 0)
    procedure = F.coalesce(f"{m}.test_procedure", F.lit(""))
    item = lambda test, kind, detail: F.when(test, F.struct(F.lit(kind).alias("issue_type"), detail.alias("detail")))
    three = fixed(F.col("raw_total"), 3)
    found = some(
        item(F.abs(F.col("confidence") - expected) > 0.05, "confidence_integrity", F.concat(F.lit("Declared "), two(F.col("confidence")), F.lit(" vs expected "), two(expected), F.lit(" (raw="), three, F.lit(")"))),
        item(doubled != "", "template_error", F.concat(F.lit("Doubled word in control_objective: "), doubled)),
        item(F.contains(procedure, F.lit("{")) & F.contains(procedure, F.lit("}")), "template_error", F.lit("Unfilled placeholder in test_procedure")),
        item((F.col(f"{m}.system_mapping_source") == "keyword_inferred") & (F.size(f"{m}.system_mapping_keywords") <= 0), "enrichment_grounding", F.lit("system_mapping_source=keyword_inferred but no keywords recorded")),
        item(F.col(f"{m}.evidence_type_source") == "extracted", "enrichment_grounding", F.lit("evidence_type_source=extracted but extraction not implemented")),
    )
    return reqs.select("doc_id", "requirement_id", F.explode(found).alias("i")).select("doc_id", "requirement_id", "i.*")


def bucket(confidence: Column) -> Column:
    out: Column | None = None
    for name, least in reversed(dims.CONFIDENCE_BUCKETS):
        out = F.lit(name) if least is None else F.when(confidence >= least, F.lit(name)).otherwise(out)
    return out


def confidence_distribution(reqs: DataFrame, *keys: str) -> DataFrame:
    """(keys, bucket, n): all five buckets of every key, empty ones too."""
    names = F.array(*[F.lit(n) for n, _ in dims.CONFIDENCE_BUCKETS])
    counts = reqs.groupBy(*keys).agg(*[F.count_if(bucket(F.col("confidence")) == n).alias(n) for n, _ in dims.CONFIDENCE_BUCKETS])
    values = F.array(*[F.col(f"`{n}`") for n, _ in dims.CONFIDENCE_BUCKETS])
    return counts.select(*keys, F.explode(F.arrays_zip(names.alias("bucket"), values.alias("n"))).alias("x")).select(*keys, "x.bucket", "x.n")


def by_type(reqs: DataFrame, *keys: str) -> DataFrame:
    return reqs.groupBy(*keys, "rule_type").agg(F.count("*").alias("n"))


def schema_coverage(reqs: DataFrame, entities: DataFrame, attributes: str = "attributes", parts: int = 16) -> DataFrame:
    """(doc_id, entity, n): requirements of the document that mention each entity label in description or attributes, zeros kept.

    Labels and requirements of a document meet as one sorted stream, labels first: these become an automaton of all of them,
    which reads every requirement once. A document's requirements are dealt to ``parts`` streams, each with its labels, and the counts are summed.
    """
    text = F.lower(F.concat_ws(" ", F.col(attributes), F.coalesce("rule_description", F.lit(""))))
    label = entities.select("doc_id", "entity", F.lower("entity").alias("text")).distinct()
    label = label.withColumns({"is_text": F.lit(False), "part": F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))})
    said = reqs.select("doc_id", F.lit(None).cast(entities.schema["entity"].dataType).alias("entity"), text.alias("text"), F.lit(True).alias("is_text"), F.pmod(F.xxhash64(text), F.lit(parts)).cast("int").alias("part"))
    rows = label.unionByName(said).select("doc_id", "part", "is_text", "entity", "text")

    def fold(rows: Iterator[tuple]) -> Iterator[tuple]:
        labels: dict[str, list] = {}
        counts: Counter = Counter()
        automaton, texts = None, 0
        for is_text, entity, text in rows:
            if not is_text:
                labels.setdefault(text, []).append(entity)
                continue
            if automaton is None:
                automaton = Automaton()
                for x in labels:
                    if x:
                        automaton.add_word(x, x)
                automaton.make_automaton()
            texts += 1
            counts.update({x for _, x in automaton.iter(text)} if len(automaton) else ())
        for x, names in labels.items():
            yield from ((e, 0 if x is None else counts[x] if x else texts) for e in names)

    kind = entities.schema["entity"].dataType.simpleString()
    return folded(rows, ("doc_id", "part"), ["is_text"], fold, f"entity {kind}, n long").groupBy("doc_id", "entity").agg(F.sum("n").alias("n"))


def classify(df: DataFrame) -> DataFrame:
    """Adds failure_type, failure_severity and is_retryable.

    Needs coverage_ratio, testability_issues, grounding_issues, schema_issues,
    schema_high, dedup_ratio, hallucination_flags, hallucination_critical,
    hallucination_high and extraction_iteration. Later checks may restore a
    retry that an earlier one took away, and the last word is hallucination's.
    """
    c = F.col
    retry = c("extraction_iteration") < 2
    critical, high = c("hallucination_critical") > 0, c("hallucination_high") > 3
    active = {
        "coverage": c("coverage_ratio") < 0.60, "testability": c("testability_issues") > 5, "grounding": c("grounding_issues") > 3,
        "schema": c("schema_high") > 3, "dedup": c("dedup_ratio") < 0.70, "hallucination": critical | high,
    }
    again = F.when(active["coverage"], retry).otherwise(False)
    again = F.when(active["testability"], False).otherwise(again)
    again = F.when(active["dedup"], retry).otherwise(again)
    again = F.when(critical | high, False).otherwise(again)
    n = sum((F.when(x, 1).otherwise(0) for x in active.values()), F.lit(0))
    strong = active["coverage"] | active["testability"] | high
    severity = F.when(critical, "critical").when(strong | (n > 1), "high").when(active["grounding"] | active["schema"] | active["dedup"], "medium").otherwise("low")
    kind = F.when(n == 0, "none").when(n > 1, "multi").otherwise(F.coalesce(*[F.when(x, F.lit(k)) for k, x in active.items()]))
    return df.withColumns({"failure_type": kind, "failure_severity": severity, "is_retryable": again})


def suggestions() -> Column:
    """Texts for what the counts of classify() show; missing_names is an array of field names."""
    c = F.col
    pct = lambda x: F.concat(fixed(x * 100, 1), F.lit("%"))
    n = lambda x: c(x).cast("string")
    cov = c("coverage_ratio")
    names = F.array_join(F.slice(F.sort_array("missing_names"), 1, 5), ", ")
    out = some(
        F.when(cov < 0.60, F.concat(F.lit("Coverage ratio "), pct(cov), F.lit(" too low. Retry with broader rule extraction (relax confidence threshold or expand rule_type scope).")))
        .when(cov < 0.80, F.concat(F.lit("Coverage ratio "), pct(cov), F.lit(" below target. Review chunks with zero extractions."))),
        F.when(c("testability_issues") > 0, F.concat(F.lit("Testability issues found ("), n("testability_issues"), F.lit("). Review rule descriptions; ensure each has measurable pass/fail condition. Require threshold_value for data_quality rules."))),
        F.when(c("grounding_issues") > 0, F.concat(F.lit("Grounding issues ("), n("grounding_issues"), F.lit("). Verify grounded_in cites source text; ensure confidence scores reflect actual inference level."))),
        F.when((c("schema_issues") > 0) & (F.size("missing_names") > 0), F.concat(F.lit("Schema compliance issues ("), n("schema_issues"), F.lit("). Missing fields: "), names, F.lit(". Update prompt to require these fields."))),
        F.when(c("dedup_ratio") < 0.70, F.concat(F.lit("Deduplication ratio "), pct(c("dedup_ratio")), F.lit(" suggests content repetition. Review potential duplicates; merge or remove lower-confidence variants."))),
        F.when(c("hallucination_critical") > 0, F.concat(F.lit("CRITICAL: "), n("hallucination_critical"), F.lit(" requirements flagged for potential hallucination. Manual review required before proceeding.")))
        .when(c("hallucination_flags") > 0, F.concat(F.lit("Hallucination risk detected ("), n("hallucination_flags"), F.lit(" flags). Review low-confidence requirements; consider stricter extraction."))),
    )
    return F.when(F.size(out) == 0, F.array(F.lit("All checks passed. Requirements ready for downstream processing."))).otherwise(out)


def quality_score() -> Column:
    """0 to 1 from the columns of classify(), avg_confidence and total_requirements; six decimals."""
    c = F.col
    total = F.greatest(c("total_requirements"), F.lit(1))
    left = lambda x: 1 - F.least(F.lit(1.0), c(x) / total)
    penalty = F.least(F.lit(0.3), c("hallucination_flags") * 0.05)
    score = 0.25 * c("coverage_ratio") + 0.25 * c("avg_confidence") + 0.15 * c("dedup_ratio") + 0.15 * left("testability_issues") + 0.10 * left("grounding_issues") + 0.10 * left("schema_issues") - penalty
    return F.when(c("total_requirements") == 0, 0.0).otherwise(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 6))


def chunk_counts(chunks: DataFrame, reqs: DataFrame) -> DataFrame:
    """(doc_id, total_chunks, chunks_processed, zero_chunks, coverage_ratio) of documents with chunks: coverage and zero_chunks in one join."""
    used = reqs.where("doc_id IS NOT NULL").select("doc_id", F.col("source_chunk_id").alias("chunk_id"), F.lit(True).alias("used")).distinct()
    each = chunks.groupBy("doc_id", "chunk_id").agg(F.count("*").alias("n")).join(used, ["doc_id", "chunk_id"], "full")
    out = each.groupBy("doc_id").agg(
        F.sum("n").alias("total_chunks"), F.count_if(F.col("used") & (F.coalesce("chunk_id", F.lit("")) != "")).alias("chunks_processed"),
        F.coalesce(F.sum(F.when(F.col("used").isNull(), F.col("n"))), F.lit(0)).alias("zero_chunks"),
    ).where("total_chunks > 0")
    return out.withColumn("coverage_ratio", F.col("chunks_processed") / F.col("total_chunks"))


def check_counts(reqs: DataFrame) -> DataFrame:
    """One row per document with the counts of all checks that look at one requirement at a time, from one pass over the requirements."""
    n = lambda name: F.size(name)
    flags, risk = hallucination_flags()
    rows = reqs.select(
        "doc_id", "confidence", "extraction_iteration", testability_issues().alias("t"), grounding_issues().alias("g"),
        at.canonical_errors(F.col("a"), F.col("rule_type")).alias("s"), flags.alias("h"), risk.alias("risk"),
    )
    return settled(rows).groupBy("doc_id").agg(
        F.count("*").alias("total_requirements"), F.round(F.avg("confidence"), 6).alias("avg_confidence"), F.max("extraction_iteration").alias("extraction_iteration"),
        F.count_if(n("t") > 0).alias("testability_issues"), F.count_if(n("g") > 0).alias("grounding_issues"),
        F.count_if(n("s") > 0).alias("schema_issues"), F.count_if(n("s") >= 2).alias("schema_high"), F.array_distinct(F.flatten(F.collect_set("s"))).alias("missing_names"),
        F.count_if(n("h") > 0).alias("hallucination_flags"), F.count_if((n("h") > 0) & (F.col("risk") == "critical")).alias("hallucination_critical"), F.count_if((n("h") > 0) & (F.col("risk") == "high")).alias("hallucination_high"),
    )


def report(chunks: DataFrame, reqs: DataFrame, listed_zero: DataFrame | None = None) -> DataFrame:
    """One row per document (of those with chunks) with all counts, ratios, classification, score and suggestions.

    listed_zero: (doc_id, listed), numbers of chunks that the extraction listed as empty.
    """
    key = ["doc_id"]
    out = chunk_counts(chunks, reqs)
    for part in (check_counts(reqs), duplicate_counts(reqs)):
        out = out.join(part, key, "left")
    counts = ["zero_chunks", "total_requirements", "avg_confidence", "testability_issues", "grounding_issues", "schema_issues", "schema_high", "hallucination_flags", "hallucination_critical", "hallucination_high", "duplicate_pairs"]
    out = out.fillna(0, counts).fillna(1, ["extraction_iteration"]).withColumn("missing_names", F.coalesce("missing_names", F.array().cast("array<string>")))
    if listed_zero is not None:
        out = out.join(listed_zero, key, "left").withColumn("coverage_ratio", reconciled(F.col("coverage_ratio"), F.col("zero_chunks"), F.coalesce("listed", F.lit(0)), F.col("total_chunks"))).drop("listed")
    out = out.withColumns({"dedup_ratio": dedup_ratio(F.col("total_requirements"), F.col("duplicate_pairs")), "unique_requirements": F.col("total_requirements") - F.col("duplicate_pairs")})
    return classify(out).withColumns({"overall_quality_score": quality_score(), "suggestions": suggestions()})


def router_signal(reports: DataFrame) -> DataFrame:
    """What a router would decide on."""
    return reports.select("doc_id", "failure_type", "failure_severity", "is_retryable", "extraction_iteration", "coverage_ratio", "overall_quality_score")
