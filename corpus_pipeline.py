"""From raw documents to a training mix: five stages, each one operator of the llm subpackage.

Stages are (name, function) with function(spark, docs, sf_dir) -> DataFrame; the
result of each is written as Parquet and read again as the next one's docs. All
but the last return the columns of documents.

Defined cases. Ids may be null (earlier than all others), repeat, and be of any type that
sorts. Quality rules drop null, empty and very short texts, so later stages see none of
them in run(); called by themselves they keep them. The n-gram Jaccard join keeps, of
each class of near copies, the row of the least id (of rows of one id in a class any one
text), and of rows equal in id and text one. Substring dedup keeps a text less its
repeated passages and drops a row only if nothing is left of it; n_chars follows.
Decontamination drops a row that holds a window of any benchmark item. The mix returns one
row for each row it gets, those that it takes no times included. Texts of any length are
judged whole, extra columns of any name pass through (n_chars, where there is one, is
recomputed), and an empty table gives an empty table at every stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewright.llm import decontaminate, jaccard, mixing, repetition, substrings
from clausewright.llm.text import read_table
from clausewright.operators.graph import shared_folder


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules keep."""
    return repetition.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each class of near copies."""
    return jaccard.representatives(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of passages that occur earlier; documents of nothing else go."""
    kept = substrings.clean(docs)
    return kept.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else kept


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of the benchmark."""
    return decontaminate.clean(docs, read_table(spark, sf_dir, "benchmark"), remove="documents")


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often the mix takes each document."""
    return mixing.mix(docs).select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", repeated_passages),
    ("benchmark decontamination", benchmark_leaks),
    ("mixing sources to target weights", source_mix),
]

#: The near-duplicate and mixing stages have no SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    at = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{k}")
        docs = spark.read.parquet(f"{at}/{k}")
    return docs
