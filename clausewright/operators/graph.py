"""Connected components of an edge table, by alternating large-star and small-star rounds.

Every round is joins and aggregations on node ids with partial sums on the map
side, and ends in a written table. The least neighbours are written before
the join, so that both of its sides are plain exchanges and Spark can split a
hub's rows; tables of every size meet in the same way. Nothing but two sums per round reaches the driver.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints and written tables: the session's spark.checkpoint.dir.

    Only a local session without one, as in tests, gets a folder of its own; on a cluster that is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder. In loops of joins: a checkpoint passes its estimate of size on, and estimates multiply with every join."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = written(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
    return both.where("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = written(down.groupBy("u").agg(F.min("v").alias("m")))
    moved = down.join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, label) for every node of edges (u, v), both long: label is the least node of its component."""
    e = written(edges.select("u", "v").where("u <> v").distinct())
    seen = None
    for _ in range(rounds):
        e = written(_small_star(written(_large_star(e))))
        now = tuple(e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    stars = e.select(F.greatest("u", "v").alias("node"), F.least("u", "v").alias("label"))
    return stars.unionByName(stars.select(F.col("label").alias("node"), "label").distinct())
