"""Mixing sources to target weights by pivotal dependent rounding.

Each document of a source should be copied target / source size times. The
integral part of that is taken as it is; the fractions are rounded together:
documents meet in pairs, and words move at random from one's expected copies
to the other's, in either direction with the odds that leave both
expectations as they were, until one of the two is integral. The other one
goes on to the next pair. A block of about ``BLOCK`` documents is a fold, the
largest first; the one fractional document that a block leaves meets those of
other blocks, level by level, so a source of any size is reduced by a tree of
equally small tasks.

Documents meet others of their size: a rung holds those within a factor of
eight, and rungs are reduced from the largest down. The last fractional
document of a rung meets the bundle of all smaller documents of its source by the
same rule: words move to or from the bundle, whose rate changes for it, until the
document is integral, or the bundle is (at no copies or at the limit; then the
document's last fraction is drawn). So what a source misses of its target is
less than one document of its smallest rung, wherever the bundles are large enough, and
every document's expected copies stay as they were. Rungs are few (one
per factor of eight in size), whatever the number of documents. Draws are
hashes of the documents, so reruns agree.

Blocks are dealt by a hash of the row, and a source's number of blocks by its
count, so a source with a third of all rows is spread like any other.

Defined cases: a null text has size 0, a null source is a source of its own
and comes last; rows that repeat are counted first and are documents of their own,
numbered, in any blocks; documents of equal size meet in the order of a hash; a null id,
or one of any type, is passed through; a text of any length is one number here; empty documents
take 0 words; an empty table gives no rows; columns may have any names. The list of
sources is sorted in one task (one row each), documents are not.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.graph import durable
from .session import named, uniform
from .text import word_count

BLOCK = 256
#: Tables of one row per source are broadcast up to this many.
SOURCES = 100_000
EPS = 1e-9


def targets(sizes: DataFrame, weights: Sequence[float] = (1.0, 2.0, 3.0), limit: float = 3.0) -> DataFrame:
    """(source, source_size, n_docs, target) of (source, size) rows.

    Sources in order (null last) weigh ``weights``, repeating. Targets share
    the sum of all sizes; the sources with the smallest limit per weight stop
    at ``limit`` times their size, and the rest share what is left.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1).cast("int"))
    by = by.withColumn("weight", w).withColumn("cap", F.lit(float(limit)) * F.col("source_size"))
    every = Window.orderBy(F.col("ratio"), F.col("source").asc_nulls_last())
    by = by.withColumn("ratio", F.col("cap") / F.col("weight"))
    before = every.rowsBetween(Window.unboundedPreceding, -1)
    ahead = every.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    by = by.withColumns({"used": F.coalesce(F.sum("cap").over(before), F.lit(0.0)), "weights": F.sum("weight").over(ahead), "total": F.sum("source_size").over(Window.partitionBy())})
    # with all sources before this one at their limits, the water level of the rest
    by = by.withColumn("level", (F.col("total") - F.col("used")) / F.col("weights"))
    by = by.withColumn("at", F.row_number().over(every))  # sources of equal ratio: the first of them, before which fewest are at their limits
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("at", "level"))).over(Window.partitionBy())["level"]
    by = by.withColumn("level", level)
    return by.select("source", "source_size", "n_docs", F.when(F.col("source_size") == 0, 0.0).otherwise(F.least("cap", F.col("level") * F.col("weight"))).alias("target"))


def item_type(id_type: str) -> str:
    return f"struct<size:bigint,key:bigint,row:bigint,doc_id:{id_type},base:bigint,p:double>"


def done_type(id_type: str) -> str:
    return f"struct<doc_id:{id_type},size:bigint,copies:bigint>"


def _whole(p: Column) -> Column:
    return (p < EPS) | (p > 1 - EPS)


def _done(x: Column, p: Column) -> Column:
    return F.struct(x["doc_id"].alias("doc_id"), x["size"].alias("size"), (x["base"] + F.when(p > 0.5, 1).otherwise(0)).alias("copies"))


def _fold(items: Column, id_type: str, seed: int) -> Column:
    """Rounds the fractions of an array of items in order: struct of done (an array) and rest (an item or null)."""
    none = F.lit(None).cast(item_type(id_type))
    zero = F.struct(F.array().cast(f"array<{done_type(id_type)}>").alias("done"), none.alias("rest"))

    def step(s: Column, b: Column) -> Column:
        a = s["rest"]
        sa, sb = a["size"].cast("double"), b["size"].cast("double")
        up = F.least(sa * (1 - a["p"]), sb * b["p"])  # words that can move to a
        down = F.least(sa * a["p"], sb * (1 - b["p"]))  # and from it
        gain = F.when(uniform(a["key"], a["row"], b["key"], b["row"], seed=seed) * (up + down) < down, up).otherwise(-down)
        met = F.struct((a["p"] + gain / sa).alias("pa"), (b["p"] - gain / sb).alias("pb"))
        rest = lambda x, p: F.struct(*[x[f].alias(f) for f in ("size", "key", "row", "doc_id", "base")], p.alias("p"))
        both = F.transform(F.array(met), lambda m: F.struct(
            F.concat(s["done"], F.filter(F.array(F.when(_whole(m["pa"]), _done(a, m["pa"])), F.when(_whole(m["pb"]), _done(b, m["pb"]))), lambda x: x.isNotNull())).alias("done"),
            F.when(~_whole(m["pa"]), rest(a, m["pa"])).when(~_whole(m["pb"]), rest(b, m["pb"])).otherwise(none).alias("rest"),
        ))
        return F.when(a.isNull(), F.struct(s["done"].alias("done"), b.cast(item_type(id_type)).alias("rest"))).otherwise(both[0])

    return F.aggregate(items, zero, step)


def _meet_bundle(state: DataFrame, limit: float, seed: int) -> DataFrame:
    """The rule between a source's last document of a rung (rest, may be null) and the bundle of its smaller ones (words at ``rate``, size ``left``)."""
    x, s = F.col("rest"), F.col("rest.size").cast("double")
    up = F.least(s * (1 - x["p"]), F.col("rate") * F.col("left"))
    down = F.least(s * x["p"], (F.lit(float(limit)) - F.col("rate")) * F.col("left"))
    u = lambda salt: uniform(x["key"], x["row"], F.lit(salt), seed=seed)
    gain = F.when(up + down <= 0, 0.0).when(u(1) * (up + down) < down, up).otherwise(-down)
    state = state.withColumn("gain", F.when(x.isNull(), 0.0).otherwise(gain))
    p = x["p"] + F.col("gain") / s
    one = F.when(_whole(p), F.when(p > 0.5, 1.0).otherwise(0.0)).otherwise(F.when(u(2) < p, 1.0).otherwise(0.0))
    rate = F.when(F.col("left") > 0, F.least(F.greatest(F.col("rate") - F.col("gain") / F.col("left"), F.lit(0.0)), F.lit(float(limit)))).otherwise(0.0)  # bounds against rounding only
    return state.withColumn("last", F.when(x.isNotNull(), _done(x, one))).withColumn("rate", rate).drop("rest", "gain")


def mix(docs: DataFrame, weights: Sequence[float] = (1.0, 2.0, 3.0), limit: float = 3.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken."""
    docs = named(docs, doc_id=id_col, text=text_col, source=source_col)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("doc_id", "text", "source").alias("key"))
    rows = rows.groupBy("doc_id", "source", "size", "key").agg(F.count("*").alias("n"))
    # one row per document again, those that repeat numbered; a table of numbers, without the texts
    rung = F.floor((F.length(F.bin("size")) - 1) / 3).cast("int")
    rows = durable(rows.select("doc_id", "source", "size", "key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("row"), F.when(F.col("size") > 0, rung).otherwise(-1).alias("rung")))
    goal = durable(targets(rows.select("source", "size"), weights, limit))
    few = goal.limit(SOURCES + 1).count() <= SOURCES
    small = F.broadcast if few else (lambda df: df)
    ladder = durable(rows.where("rung >= 0").groupBy("source", "rung").agg(F.count("*").alias("n"), F.sum("size").alias("held")))
    rungs = [(r["rung"], r["n"]) for r in ladder.groupBy("rung").agg(F.max("n").alias("n")).orderBy(F.desc("rung")).collect()]  # at most 21
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    state = goal.select("source", "source_size", "target", rate.alias("rate"), F.col("source_size").alias("left"))
    columns = ["source", "source_size", "target"]
    same = F.col("a.source").eqNullSafe(F.col("b.source"))
    parts = [rows.where("rung < 0").alias("a").join(small(goal).alias("b"), same).select("a.source", "b.source_size", "b.target", F.struct("a.doc_id", "a.size", F.lit(0).cast("long").alias("copies")).alias("d"))]
    for rung, most in rungs:
        held = ladder.where(F.col("rung") == rung).drop("rung")
        at = state.alias("a").join(small(held).alias("b"), same).select("a.source", "source_size", "target", "rate", "n")
        items = rows.where(F.col("rung") == rung).alias("a").join(small(at).alias("b"), same).select("a.doc_id", "a.size", "a.key", "a.row", "b.*")
        fraction = F.col("rate") - F.floor("rate")
        items = items.withColumns({"p": F.when(_whole(fraction), 0.0).otherwise(fraction), "base": F.when(fraction > 1 - EPS, F.ceil("rate")).otherwise(F.floor("rate"))})
        parts.append(items.where("p = 0").select(*columns, F.struct("doc_id", "size", F.col("base").alias("copies")).alias("d")))
        blocks = F.ceil(F.col("n") / BLOCK)
        open_items = items.where("p > 0").select(*columns, blocks.alias("blocks"), F.pmod(F.xxhash64("key", "row", F.lit(seed)), blocks).alias("block"), F.struct("size", "key", "row", "doc_id", "base", "p").alias("x"))
        level = 0
        while True:
            folded = open_items.groupBy(*columns, "blocks", "block").agg(F.sort_array(F.collect_list("x"), False).alias("x"))
            folded = durable(folded.select(*columns, "blocks", "block", _fold(F.col("x"), kind, seed + level).alias("f")))
            parts.append(folded.select(*columns, F.explode("f.done").alias("d")))
            most, level = -(-most // BLOCK), level + 1
            if most <= 1:
                break
            blocks = F.ceil(F.col("blocks") / BLOCK)
            open_items = folded.where("f.rest IS NOT NULL").select(*columns, blocks.alias("blocks"), F.pmod(F.xxhash64("block", F.lit(seed + level)), blocks).alias("block"), F.col("f.rest").alias("x"))
        rest = folded.select("source", "f.rest").where("rest IS NOT NULL")
        state = state.alias("a").join(small(held).alias("b"), same, "left").select("a.source", "source_size", "target", "rate", (F.col("left") - F.coalesce("held", F.lit(0))).alias("left"))
        state = state.alias("a").join(small(rest).alias("b"), same, "left").select("a.*", "b.rest")
        state = durable(_meet_bundle(state, limit, seed))
        parts.append(state.where("last IS NOT NULL").select(*columns, F.col("last").alias("d")))
        state = state.drop("last")
    out = reduce(DataFrame.unionByName, parts)
    return out.select("d.doc_id", "source", "d.size", "source_size", "target", "d.copies", (F.col("d.size") * F.col("d.copies")).alias("taken"))
