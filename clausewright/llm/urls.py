"""URL filters: path rules first, then trust propagated over the host graph.

Everything is DataFrame expressions. Hosts are seeded from the rules: trust by
the share of allowed pages that a host holds, distrust by the share of blocked
ones. Trust flows along links between hosts (personalised PageRank), distrust
against them; a host is blocked where distrust outweighs trust. Links are
counted per pair of hosts before anything is joined, so a host with a third of
all pages is one row of the graph. Rounds go on until no score moves by more than
the tolerance, however long the paths.

Mass that reaches a host without links is not dealt out again. Relative links
stay on their host and are no edges.

Defined cases: a null url, or one without ``://``, has empty host and path, fits
no rule and is judged as the empty host; a null html has no links; ids may be null or of any
type; repeated rows are judged alike, and each counts; equal trust and distrust allow, so with
no rules every host is allowed; a page of any length is searched whole; an empty table
gives no rows; extra columns are left alone, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import durable
from .session import named

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?(?:https?:)?//([^/?#"'\s>]+)"""
#: (rule, verdict): host, from the first slash on the path's prefix.
Rules = Sequence[tuple[str, str]]
CHAINED_RULES = 64
#: The table of hosts meets the pages by broadcast up to this many rows.
BROADCAST_HOSTS = 200_000


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def _chained(rows: DataFrame, rules: Rules) -> DataFrame:
    """Few rules: one expression, longest first."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r, v in sorted(rules, key=lambda x: (len(x[0]), x[0])):
        host, path = r.split("/", 1)
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(f"/{path}")
        rule, verdict = F.when(fits, F.lit(r)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rows.withColumns({"rule": rule, "rule_verdict": verdict})


def _joined(rows: DataFrame, rules: Rules) -> DataFrame:
    """Many rules: those of each distinct host's suffixes, joined by host."""
    spark = rows.sparkSession
    table = spark.createDataFrame([(r.split("/", 1)[0], "/" + r.split("/", 1)[1], r, v) for r, v in rules], "suffix string, prefix string, rule string, rule_verdict string")
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size("labels")), lambda i: F.array_join(F.slice("labels", i, F.size("labels")), "."))
    hosts = rows.select("host").distinct().withColumn("labels", labels).select("host", F.explode(suffixes).alias("suffix"))
    own = hosts.join(table, "suffix").groupBy("host").agg(F.collect_list(F.struct(F.length("rule").alias("n"), "rule", "rule_verdict", "prefix")).alias("rules"))
    best = F.array_max(F.filter("rules", lambda r: F.col("path").startswith(r["prefix"])))
    return rows.join(own, "host", "left").withColumn("best", best).withColumns({"rule": F.col("best.rule"), "rule_verdict": F.col("best.rule_verdict")}).drop("rules", "best")


def rounds_needed(damping: float, tolerance: float) -> int:
    """Rounds after which no score can move by more than the tolerance: round k moves at most (1 - damping) * damping^k in all."""
    if not 0 <= damping < 1 or tolerance <= 0:
        raise ValueError((damping, tolerance))
    return 1 if damping * (1 - damping) <= tolerance else math.ceil(math.log(tolerance / (1 - damping)) / math.log(damping))


def propagate(seeds: DataFrame, edges: DataFrame, damping: float, iterations: int | None, tolerance: float) -> DataFrame:
    """(host, score) from seeds (host, seed) along edges (src, dst, share), until no score moves by more than the tolerance.

    ``iterations`` bounds the rounds (default: what the tolerance can need); scores that still move then are an error.
    """
    # one more for rounding; the seeds sum to 1 at most
    iterations = rounds_needed(damping, tolerance) + 1 if iterations is None else iterations
    scores = seeds.select("host", F.col("seed"), (F.lit(1 - damping) * F.col("seed")).alias("score"))
    scores = durable(scores)
    for _ in range(iterations):
        sent = edges.join(scores, edges["src"] == scores["host"]).groupBy("dst").agg(F.sum(F.col("score") * F.col("share")).alias("sent"))
        new = scores.join(sent, scores["host"] == sent["dst"], "full").select(
            F.coalesce("host", "dst").alias("host"),
            F.coalesce("seed", F.lit(0.0)).alias("seed"),
            (F.lit(1 - damping) * F.coalesce("seed", F.lit(0.0)) + F.lit(damping) * F.coalesce("sent", F.lit(0.0))).alias("score"),
            F.coalesce("score", F.lit(0.0)).alias("was"),
        )
        new = durable(new)
        moved = new.agg(F.max(F.abs(F.col("score") - F.col("was"))).alias("d")).first()["d"]
        scores = new.drop("was")
        if moved is None or moved <= tolerance:
            break
    else:
        raise RuntimeError(f"scores still moved by more than {tolerance} after {iterations} rounds")
    return scores.select("host", "score")


def judge(pages: DataFrame, rules: Rules, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", damping: float = 0.85, iterations: int | None = None, tolerance: float = 1e-9) -> DataFrame:
    """One row per page: its id, host, path, rule, trust, distrust and verdict."""
    pages = named(pages, page_id=id_col, url=url_col, html=html_col)
    base = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    ruled = (_chained if len(rules) <= CHAINED_RULES else _joined)(base, rules)
    counts = ruled.groupBy("host").agg(F.count_if(F.col("rule_verdict") == "allow").alias("allowed"), F.count_if(F.col("rule_verdict") == "block").alias("blocked"))
    counts = durable(counts)
    total = counts.agg(F.coalesce(F.sum("allowed"), F.lit(0)).alias("a"), F.coalesce(F.sum("blocked"), F.lit(0)).alias("b")).first()
    links = pages.select(host_of(F.col("url")).alias("src"), F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("dst"))
    links = links.select("src", F.translate("dst", UPPER, LOWER).alias("dst")).where("src <> '' AND dst <> '' AND src <> dst")
    links = durable(links.groupBy("src", "dst").count())
    forward = links.join(links.groupBy("src").agg(F.sum("count").alias("total")), "src").select("src", "dst", (F.col("count") / F.col("total")).alias("share"))
    backward = links.join(links.groupBy("dst").agg(F.sum("count").alias("total")), "dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), (F.col("count") / F.col("total")).alias("share"))
    trust = propagate(counts.where("allowed > 0").select("host", (F.col("allowed") / F.lit(float(max(total["a"], 1)))).alias("seed")), forward, damping, iterations, tolerance)
    distrust = propagate(counts.where("blocked > 0").select("host", (F.col("blocked") / F.lit(float(max(total["b"], 1)))).alias("seed")), backward, damping, iterations, tolerance)
    by_host = counts.select("host").join(trust.withColumnRenamed("score", "trust"), "host", "left").join(distrust.withColumnRenamed("score", "distrust"), "host", "left")
    by_host = by_host.select("host", F.round(F.coalesce("trust", F.lit(0.0)), 12).alias("trust"), F.round(F.coalesce("distrust", F.lit(0.0)), 12).alias("distrust"))
    verdict = F.coalesce("rule_verdict", F.when(F.col("distrust") > F.col("trust"), "block").otherwise("allow"))
    few = by_host.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS
    return ruled.join(F.broadcast(by_host) if few else by_host, "host", "left").select("page_id", "host", "path", "rule", "trust", "distrust", verdict.alias("verdict"))
