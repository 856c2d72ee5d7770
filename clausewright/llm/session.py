"""Small session helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.graph import durable

#: The rank of a null id.
FIRST = -(1 << 63)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def uniform(*cols: Column | str, seed: int = 0) -> Column:
    """A reproducible number in [0, 1) of the given columns."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *cols), 11)).cast("double") / F.lit(float(1 << 53))


def plain(docs: DataFrame) -> DataFrame:
    """``docs`` with its columns named c0, c1, ...: whatever they were called, they clash with nothing."""
    return docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])


def named(docs: DataFrame, **roles: str) -> DataFrame:
    """The columns of ``docs`` that play a role, under the names of their roles."""
    at = {role: f"c{docs.columns.index(name)}" for role, name in roles.items()}
    return plain(docs).select(*[F.col(c).alias(role) for role, c in at.items()])


def ranked(docs: DataFrame, id_col: str, rank: str) -> DataFrame:
    """``docs`` with a long column that sorts as its ids do; null comes first.

    Integers are their own rank. Ids of other types are sorted once, by range, and joined with their places.
    """
    if isinstance(docs.schema[id_col].dataType, T.IntegralType):
        return docs.withColumn(rank, F.coalesce(F.col(id_col).cast("long"), F.lit(FIRST)))
    ids = docs.select(F.col(id_col).alias("r_of")).where("r_of IS NOT NULL").distinct().sort("r_of")
    ids = durable(ids.select("r_of", F.monotonically_increasing_id().alias("r_at")))
    joined = docs.join(ids, docs[id_col] == ids["r_of"], "left").drop("r_of")
    return joined.withColumn(rank, F.coalesce("r_at", F.lit(FIRST))).drop("r_at")
