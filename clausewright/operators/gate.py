"""The gate after schema discovery."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dims
from ..functions.text import fixed


def _threshold(fmt: Column, i: int, gates: Mapping[str, tuple[float, float]]) -> Column:
    out = F.lit(gates["default"][i])
    for name, values in gates.items():
        if name != "default":
            out = F.when(fmt == name, F.lit(values[i])).otherwise(out)
    return out


def _percent(x: Column) -> Column:
    return F.concat(fixed(x * 100, 1), F.lit("%"))


def decide(df: DataFrame, gates: Mapping[str, tuple[float, float]] = dims.GATES) -> DataFrame:
    """Adds auto_accept, human_review, failing_checks, conditional_flags, decision and rationale.

    Needs document_format and avg_confidence (null: no schema). If the columns
    total_requirements, schema_issues, coverage_ratio, testability_issues and
    hallucination_flags are there and not null, they are checked as well.
    gates: (auto_accept, human_review) by format.
    """
    df = df.withColumns({"auto_accept": _threshold(F.col("document_format"), 0, gates), "human_review": _threshold(F.col("document_format"), 1, gates)})
    avg = F.col("avg_confidence")
    text = lambda c: F.col(c).cast("string")
    low = F.concat(F.lit("avg_confidence="), fixed(avg, 3), F.lit(" < "))
    failing = [F.when(avg < F.col("human_review"), F.concat(low, text("human_review")))]
    flags = [F.when((avg >= F.col("human_review")) & (avg < F.col("auto_accept")), F.concat(low, text("auto_accept")))]
    if "total_requirements" in df.columns:
        ratio = 1 - F.col("schema_issues") / F.greatest(F.col("total_requirements"), F.lit(1))
        failing += [
            F.when(ratio < dims.MIN_SCHEMA_COMPLIANCE, F.concat(F.lit("schema_compliance="), _percent(ratio), F.lit(" < "), _percent(F.lit(dims.MIN_SCHEMA_COMPLIANCE)))),
            F.when(F.col("coverage_ratio") < dims.MIN_COVERAGE, F.concat(F.lit("coverage="), _percent(F.col("coverage_ratio")), F.lit(" < "), _percent(F.lit(dims.MIN_COVERAGE)))),
        ]
        flags += [F.when(F.col(c) > 0, F.concat(F.lit(f"{c}="), text(c))) for c in ("testability_issues", "hallucination_flags")]
    keep = lambda xs: F.filter(F.array(*xs), lambda x: x.isNotNull())
    df = df.withColumns({"failing_checks": F.when(avg.isNull(), F.array(F.lit("no_schema_map"))).otherwise(keep(failing)), "conditional_flags": keep(flags)})
    failed, flagged = F.size("failing_checks") > 0, F.size("conditional_flags") > 0
    decision = F.when(failed, "reject").when((avg >= F.col("auto_accept")) & ~flagged, "accept").when(avg >= F.col("human_review"), "human_review").otherwise("reject")
    rationale = (
        F.when(avg.isNull(), "No schema map available for evaluation.")
        .when(failed, F.concat(F.lit("Failed checks: "), F.array_join("failing_checks", "; ")))
        .when(decision == "accept", F.concat(F.lit("All thresholds met. Confidence="), fixed(avg, 3)))
        .otherwise(F.concat(F.lit("Needs review: "), F.when(flagged, F.array_join("conditional_flags", "; ")).otherwise("confidence below auto_accept")))
    )
    return df.withColumns({"decision": decision, "score": F.round(F.coalesce(avg, F.lit(0.0)), 3), "rationale": rationale})
