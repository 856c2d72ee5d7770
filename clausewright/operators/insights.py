"""Summaries over requirements: quality, risks, shares, tiers, recommendations, pages.

Needs rule_type, confidence, schema_status, grounding_classification,
data_source, fragment_warning and rule_description.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fixed
from .evaluate import some


def tier(confidence: Column) -> Column:
    return F.when(confidence >= 0.85, "high").when(confidence >= 0.65, "medium").otherwise("low")


def quality_tier(mean: Column) -> Column:
    return F.when(mean >= 90, "Excellent").when(mean >= 75, "Good").when(mean >= 60, "Fair").otherwise("Needs Review")


def automation_tier(automated: Column, total: Column) -> Column:
    share = automated * 100 / F.greatest(total, F.lit(1))
    return F.when(total == 0, "Unknown").when(share >= 80, "Highly Automatable").when(share >= 60, "Mostly Automatable").when(share >= 40, "Mixed Automation").otherwise("Requires Manual Effort")


def counts(reqs: DataFrame, *keys: str) -> DataFrame:
    """One row per key with everything the other functions here need: a single aggregation."""
    c = F.col
    status = F.coalesce("schema_status", F.lit("valid"))
    return reqs.groupBy(*keys).agg(
        F.count("*").alias("total"),
        F.count_if(status == "valid").alias("valid"),
        F.count_if(F.coalesce("grounding_classification", F.lit("")) == "EXACT").alias("exact"),
        F.count_if(F.coalesce("data_source", F.lit("")) != "").alias("sourced"),
        F.count_if(status.isin("rejected", "repaired")).alias("schema_issues"),
        F.count_if(F.coalesce("fragment_warning", F.lit(False))).alias("fragments"),
        F.count_if(c("confidence") >= 0.85).alias("high"),
        F.count_if((c("confidence") >= 0.65) & (c("confidence") < 0.85)).alias("medium"),
        F.count_if(c("confidence") < 0.65).alias("low"),
        F.round(F.avg("confidence"), 3).alias("average_confidence"),
    )


def _pct(part: Column) -> Column:
    return F.when(F.col("total") > 0, part * 100 / F.col("total")).otherwise(0.0)


def one(x: Column) -> Column:
    return F.round(x.cast("decimal(20,10)"), 1).cast("double")


def quality(c: DataFrame) -> DataFrame:
    """Adds percentages and the tier of their mean."""
    parts = [_pct(F.col(x)) for x in ("valid", "exact", "sourced")]
    mean = (parts[0] + parts[1] + parts[2]) / 3
    return c.withColumns({"schema_completeness_pct": one(parts[0]), "grounding_quality_pct": one(parts[1]), "data_source_coverage_pct": one(parts[2]), "overall_quality_tier": quality_tier(mean)})


def risk_flags(c: DataFrame, *keys: str) -> DataFrame:
    """(keys, severity, issue, detail, impact, n): one row per flag that holds."""
    col, n = F.col, lambda x: F.col(x).cast("string")
    lacking = fixed(100 - _pct(col("sourced")), 1)
    flag = lambda test, severity, issue, detail, impact, count: F.when(test, F.struct(severity.alias("severity"), F.lit(issue).alias("issue"), detail.alias("detail"), F.lit(impact).alias("impact"), count.alias("n")))
    found = some(
        flag(_pct(col("sourced")) < 80, F.lit("medium"), "Data source coverage below 80%", F.concat(lacking, F.lit("% of requirements lack data_source mapping")), "Asset lineage and impact analysis will be incomplete", col("total") - col("sourced")),
        flag(col("schema_issues") > 0, F.when(col("schema_issues") < col("total") * 0.1, "low").otherwise("medium"), "Schema compliance issues detected", F.concat(n("schema_issues"), F.lit(" requirements have missing or invalid fields")), "May require manual review before ingestion", col("schema_issues")),
        flag(col("fragments") > 0, F.lit("low"), "Fragment context warnings", F.concat(n("fragments"), F.lit(" requirements start with demonstrative pronouns (missing context)")), "May need manual review for context validation", col("fragments")),
        flag(col("low") > 0, F.lit("low"), "Low confidence requirements", F.concat(n("low"), F.lit(" requirements below 0.65 confidence threshold")), "Recommend manual review for accuracy validation", col("low")),
    )
    return c.select(*keys, F.explode(found).alias("f")).select(*keys, "f.*")


def rule_type_shares(reqs: DataFrame, *keys: str) -> DataFrame:
    by = reqs.groupBy(*keys, "rule_type").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(*keys))
    return by.withColumn("percentage", one(F.col("n") * 100 / total))


def confidence_tiers(c: DataFrame) -> DataFrame:
    return c.withColumns({f"{x}_pct": one(_pct(F.col(x))) for x in ("high", "medium", "low")})


def hallucination_risk(flags: DataFrame, totals: DataFrame, *keys: str) -> DataFrame:
    """Flags of evaluate.hallucination() against the number of requirements."""
    found = flags.groupBy(*keys).agg(F.count("*").alias("hallucination_count"), F.count_if(F.col("risk") == "critical").alias("critical_count"), F.count_if(F.col("risk") == "high").alias("high_count"))
    out = totals.join(found, list(keys), "left").fillna(0, ["hallucination_count", "critical_count", "high_count"])
    return out.withColumn("hallucination_pct", one(_pct(F.col("hallucination_count"))))


def recommendations(gate: Column | None = None) -> Column:
    """Texts from the columns of counts(); gate: the gate's decision."""
    col, n = F.col, lambda x: F.col(x).cast("string")
    lacking = fixed(100 - _pct(col("sourced")), 0)
    return some(
        F.when(_pct(col("sourced")) < 80, F.concat(F.lit("Improve data source mapping: "), lacking, F.lit("% of requirements need asset linkage. Review chunking strategy to capture table headers and section context."))),
        F.when(col("low") > 0, F.concat(F.lit("Manual review recommended for "), n("low"), F.lit(" low-confidence requirements. These may benefit from additional context or prompt refinement."))),
        F.when(col("schema_issues") > col("total") * 0.1, F.concat(F.lit("Address schema compliance: "), n("schema_issues"), F.lit(" requirements have issues. Review schema_repair logic or prompt guidance for missing fields."))),
        F.when(col("fragments") > 0, F.concat(F.lit("Validate "), n("fragments"), F.lit(" fragment warnings. These requirements may have incomplete context due to chunking boundaries."))),
        F.when(F.lit(False) if gate is None else gate == "human_review", "Gate decision is 'human_review'. Review failing checks before ingestion."),
    )


def automation(reqs: DataFrame, *keys: str) -> DataFrame:
    """Automated, manual and hybrid controls and the readiness tier; needs control_metadata."""
    of = lambda x: F.count_if(F.col("control_metadata.automated") == x)
    out = reqs.groupBy(*keys).agg(of("automated").alias("automated"), of("manual").alias("manual"), of("hybrid").alias("hybrid"), F.count("*").alias("total"))
    return out.withColumn("automation_tier", automation_tier(F.col("automated"), F.col("total")))


def filtered(reqs: DataFrame, rule_type: str | None = None, confidence_tier: str | None = None, search: str = "") -> DataFrame:
    """Rows of a type, a tier (High, Medium, Low) and with a text in the description, whatever its case."""
    if rule_type:
        reqs = reqs.where(F.col("rule_type") == rule_type)
    if confidence_tier:
        reqs = reqs.where(tier(F.col("confidence")) == confidence_tier.lower())
    if search:
        reqs = reqs.where(F.contains(F.lower("rule_description"), F.lit(search.lower())))
    return reqs


def page(reqs: DataFrame, number: int, size: int = 20, sort: str = "confidence", descending: bool = True, key: str = "requirement_id") -> DataFrame:
    """One page of a stable order."""
    order = F.col(sort).desc() if descending else F.col(sort).asc()
    return reqs.orderBy(order, F.col(key)).offset(size * (number - 1)).limit(size)


def attribute_summary(fields: Column, data_source: Column, control_type: Column) -> Column:
    """First three applicable fields, else the data source, else the control type."""
    some_fields = F.concat(F.array_join(F.slice(fields, 1, 3), ", "), F.when(F.size(fields) > 3, "...").otherwise(""))
    return F.coalesce(F.when(F.size(fields) > 0, some_fields), F.nullif(data_source, F.lit("")), F.nullif(control_type, F.lit("")), F.lit("N/A"))


def export_rows(reqs: DataFrame) -> DataFrame:
    """The flat export: eight text columns."""
    return reqs.select(
        F.col("requirement_id").alias("Requirement ID"), F.col("rule_type").alias("Rule Type"), F.col("rule_description").alias("Description"),
        fixed(F.col("confidence"), 2).alias("Confidence"), F.coalesce("grounded_in", F.lit("")).alias("Grounding"),
        F.coalesce(F.array_join("applicable_fields", "; "), F.lit("")).alias("Applicable Fields"), F.coalesce("data_source", F.lit("")).alias("Data Source"), F.coalesce("control_type", F.lit("")).alias("Control Type"),
    )
