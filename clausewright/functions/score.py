"""Confidence scoring of requirements: a chain of narrow columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import attributes as at
from . import grounding as gr
from .text import fixed, half_up, score_tokens, settled


def with_evidence(df: DataFrame, description: str = "rule_description", grounded_in: str = "grounded_in", profile: gr.Profile = gr.LIVE) -> DataFrame:
    """Adds description_words, grounded_words, intersection, jaccard_score, matched_phrases, phrase_count, grounding_match."""
    d, g = F.col(description), F.col(grounded_in)
    df = settled(df.withColumns({"_dt": score_tokens(d), "_gt": score_tokens(g), "_ph": gr.phrases(g, d)}))
    df = df.withColumns({"_j": gr.jaccard(F.col("_dt"), F.col("_gt")), "_empty": (F.size("_dt") == 0) | (F.size("_gt") == 0)})
    n = F.when(F.col("_empty"), 0).otherwise(F.size("_ph"))
    return df.withColumns(
        {
            "description_words": F.size("_dt"),
            "grounded_words": F.size("_gt"),
            "intersection": F.size(F.array_intersect("_dt", "_gt")),
            "jaccard_score": half_up(F.col("_j"), 3),
            "matched_phrases": F.when(F.col("_empty"), F.array().cast("array<string>")).otherwise(F.col("_ph")),
            "phrase_count": n,
            "grounding_match": F.when(F.col("_empty"), 0.0).otherwise(gr.match_score(F.col("_j"), n, profile)),
        }
    ).drop("_dt", "_gt", "_ph", "_j", "_empty")


#: What evidence and the scores of texts are made of.
TEXTS = ("rule_type", "rule_description", "grounded_in")


def with_texts(df: DataFrame, profile: gr.Profile = gr.LIVE) -> DataFrame:
    """Adds evidence and the features of the texts alone."""
    d, g = F.col("rule_description"), F.col("grounded_in")
    return with_evidence(df, profile=profile).withColumns({"coherence": gr.coherence(d, g), "domain_signals": gr.domain_signals(d, g, profile)})


def with_confidence(df: DataFrame, profile: gr.Profile = gr.LIVE) -> DataFrame:
    """Adds the six features, raw_total, confidence, grounding_classification, requires_review and rationale.

    Needs rule_type, rule_description, grounded_in and a VARIANT column a; what ``with_texts`` adds may be there already.
    """
    a, kind, d = F.col("a"), F.col("rule_type"), F.col("rule_description")
    if "grounding_match" not in df.columns:
        df = with_texts(df, profile)
    df = df.withColumns({"completeness": at.completeness(a, kind, profile), "quantification": at.quantification(a, d), "schema_compliance": at.compliance(a, kind, profile)})
    df = settled(df)
    parts = ("grounding_match", "completeness", "quantification", "schema_compliance", "coherence", "domain_signals")
    total = sum((F.col(p).cast("decimal(10,3)") for p in parts[1:]), F.col(parts[0]).cast("decimal(10,3)"))
    df = df.withColumn("raw_total", total.cast("double"))
    df = df.withColumns({"confidence": clamp(F.col("raw_total"), 2), "grounding_classification": gr.classify(F.col("grounding_match"), F.col("jaccard_score"), F.col("phrase_count"))})
    df = df.withColumn("requires_review", (F.col("grounding_classification") == "INFERENCE") & (F.col("jaccard_score") < 0.20))
    return settled(df.withColumn("rationale", rationale()))


def clamp(x: Column, digits: int = 2) -> Column:
    """Into [0.50, 0.99], rounded half up."""
    return half_up(F.least(F.lit(0.99), F.greatest(F.lit(0.50), x)), digits)


def rationale() -> Column:
    """The score in words; of cut-offs that no score can reach, the texts stay for older profiles."""
    m, share = F.col("grounding_match"), F.concat(fixed(F.col("jaccard_score") * 100, 0), F.lit("%"))
    parts = [
        F.when(m >= 0.25, F.concat(F.lit("Strong grounding ("), share, F.lit(" word overlap, "), F.col("phrase_count").cast("string"), F.lit(" phrase matches)")))
        .when(m >= 0.15, F.concat(F.lit("Moderate grounding ("), share, F.lit(" word overlap)")))
        .otherwise(F.concat(F.lit("Weak grounding ("), share, F.lit(" word overlap)"))),
        F.when(F.col("completeness") >= 0.18, "attributes complete").when(F.col("completeness") >= 0.10, "some attributes missing").otherwise("many attributes missing"),
        F.when(F.col("quantification") >= 0.15, "well-quantified").when(F.col("quantification") >= 0.10, "partially quantified").when(F.col("quantification") > 0, "minimal quantification"),
        F.when(F.col("schema_compliance") >= 0.15, "schema-compliant").otherwise("schema violations"),
        F.when(F.col("coherence") < 0.10, "potential contradictions"),
        F.when(F.col("domain_signals") >= 0.05, "regulatory keywords present"),
    ]
    return F.concat(F.concat_ws("; ", *parts), F.lit("."), F.when(F.col("requires_review"), " MANUAL REVIEW REQUIRED: INFERENCE with jaccard < 0.30.").otherwise(""))
