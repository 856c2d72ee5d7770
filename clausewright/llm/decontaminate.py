"""Benchmark decontamination by a broadcast set of test n-grams.

Words are lower-cased (A-Z) runs of letters, digits and non-ASCII. A window is
``n`` consecutive words of a benchmark item; an item of fewer words is one
window. Every window of a document is hashed by combining hashes of windows
half as long, looked up in the set of window hashes, and each hit is verified
on the words themselves. One narrow pass over the texts, built-in expressions
only; what is dealt out afterwards is one row per document and verified window.

The hash set is part of the plan, and so of what is broadcast with the tasks, while
the benchmark has at most ``SET_WINDOWS`` windows (counted first); beyond that the
windows of the documents are joined with those of the benchmark by hash. Hashes
are of words in full lower case, which can only add candidates: either way every hit is
verified on the words as they are (A-Z lower-cased).

Defined cases: a null text or item has no words; a null doc_id stays null, ids may be of any
type; rows that repeat are judged alike and each returned; items of equal text all
count; a text of any length is one array of words; an empty benchmark hits nothing, an empty
table gives no rows; extra columns are left alone, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import durable
from .session import named, plain

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"
SET_WINDOWS = 20_000


def _words(df: DataFrame, text: str) -> DataFrame:
    raw = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(WORD), F.lit(0))
    # a hash of the fully lower-cased word can only add candidates
    return df.withColumn("_w", raw).withColumn("_h1", F.transform("_w", lambda w: F.xxhash64(F.lower(w))))


def _roll(df: DataFrame, lengths: list[int]) -> DataFrame:
    """Adds _w<n>: the hashes of all windows of n words, for each n."""
    k = 1
    while 2 * k <= max(lengths, default=1):
        df = df.withColumn(f"_h{2 * k}", F.zip_with(f"_h{k}", F.slice(f"_h{k}", k + 1, F.size("_w")), lambda a, b: F.xxhash64(a, b)))
        k *= 2
    for n in lengths:
        parts = [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]
        at, last = parts[0], f"_h{parts[0]}"
        for p in parts[1:]:
            df = df.withColumn(f"_a{n}_{p}", F.zip_with(last, F.slice(f"_h{p}", at + 1, F.size("_w")), lambda a, b: F.xxhash64(a, b)))
            at, last = at + p, f"_a{n}_{p}"
        df = df.withColumn(f"_w{n}", F.slice(last, 1, F.greatest(F.size("_w") - n + 1, F.lit(0))))
    return df


def _spell(start: Column, n: Column) -> Column:
    """The exact window from the 0-based start, as one string."""
    return F.array_join(F.transform(F.slice("_w", start + 1, n), lambda w: F.translate(w, UPPER, LOWER)), " ")


def benchmark_windows(items: DataFrame, n: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(w, n, h, items): each distinct window, its length, hash and sorted items."""
    rows = _words(named(items, item=id_col, _t=text_col).withColumn("item", F.col("item").cast("string")), "_t").where("size(_w) > 0")
    rows = _roll(rows, list(range(1, n + 1)))
    hashes = F.when(F.size("_w") >= n, F.col(f"_w{n}"))
    for k in range(n - 1, 0, -1):
        hashes = hashes.when(F.size("_w") == k, F.col(f"_w{k}"))
    rows = rows.select("item", "_w", F.least(F.size("_w"), F.lit(n)).alias("n"), F.posexplode(hashes).alias("at", "h"))
    # read several times: kept
    return durable(rows.select("item", "n", "h", _spell(F.col("at"), F.col("n")).alias("w")).groupBy("w", "n", "h").agg(F.sort_array(F.collect_set("item")).alias("items")))


def _found(k: int, hashes: list[int]) -> Column:
    """Candidates of k words: their windows' hashes are in the set."""
    places = F.filter(F.transform(f"_w{k}", lambda h, i: F.when(h.isin(hashes), i)), lambda i: i.isNotNull())
    return F.transform(places, lambda i: F.struct(F.lit(k).alias("n"), i.alias("at")))


def _placed(k: int) -> Column:
    return F.transform(f"_w{k}", lambda h, i: F.struct(F.lit(k).alias("n"), i.alias("at"), h.alias("h")))


def judged(docs: DataFrame, items: DataFrame, n: int = 10, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> tuple[DataFrame, DataFrame]:
    """docs (plain column names) with _w (words), _hits (array of candidates: n, at and w), and the benchmark's windows."""
    windows = benchmark_windows(items, n, item_id, item_text)
    lengths = [r["n"] for r in windows.select("n").distinct().orderBy("n").collect()]  # at most n values
    count = windows.limit(SET_WINDOWS + 1).count()
    known = {k: [] for k in lengths}
    rows = _roll(_words(docs.withColumn("_t", docs[text_col]), "_t"), lengths)
    if count <= SET_WINDOWS:
        for r in windows.select("n", "h").distinct().collect():  # at most SET_WINDOWS rows
            known[r["n"]].append(r["h"])
        found = [_found(k, known[k]) for k in lengths]
        empty = F.array().cast("array<struct<n:int,at:int>>")
        rows = rows.withColumn("_c", F.concat(*found) if found else empty)
        spelled = F.transform("_c", lambda c: F.struct(c["n"].alias("n"), c["at"].alias("at"), _spell(c["at"], c["n"]).alias("w")))
        return rows.withColumn("_hits", spelled), windows
    key = F.xxhash64(*[F.col(c) for c in docs.columns])
    rows = rows.withColumn("_key", key)
    every = F.concat(*[_placed(k) for k in lengths])
    flat = rows.select("_key", F.explode(every).alias("c")).select("_key", "c.*")
    flat = flat.join(windows.select("n", "h").distinct(), ["n", "h"], "left_semi").distinct()
    flat = flat.groupBy("_key").agg(F.sort_array(F.collect_list(F.struct("n", "at"))).alias("_c"))
    rows = rows.join(flat, "_key", "left").withColumn("_c", F.coalesce("_c", F.array().cast("array<struct<n:int,at:int>>")))
    spelled = F.transform("_c", lambda c: F.struct(c["n"].alias("n"), c["at"].alias("at"), _spell(c["at"], c["n"]).alias("w")))
    return rows.withColumn("_hits", spelled), windows


def _covered(hits: str) -> Column:
    """Number of words inside any of the hits."""
    zero = F.struct(F.lit(0).alias("until"), F.lit(0).cast("long").alias("total"))
    order = F.array_sort(F.transform(hits, lambda c: F.struct(c["at"].alias("at"), c["n"].alias("n"))))
    step = lambda s, c: F.struct(F.greatest(s["until"], c["at"] + c["n"]).alias("until"), (s["total"] + F.greatest(F.lit(0), c["at"] + c["n"] - F.greatest(s["until"], c["at"]))).alias("total"))
    return F.aggregate(order, zero, step, lambda s: s["total"])


def report(docs: DataFrame, items: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    rows, windows = judged(named(docs, doc_id=id_col, text=text_col), items, n, "text", item_id, item_text)
    rows = rows.select("doc_id", F.xxhash64("doc_id", "text").alias("_key"), F.size("_w").cast("long").alias("n_words"), "_hits")
    spelled = F.array_distinct(F.transform("_hits", lambda c: c["w"]))
    rows = rows.select("doc_id", "_key", "n_words", "_hits", F.posexplode_outer(spelled).alias("k", "w"))
    small = windows.limit(SET_WINDOWS + 1).count() <= SET_WINDOWS
    right = windows.select("w", "items")
    # rows without a candidate look up what no window is, each its own: they are not dealt to one task
    rows = rows.withColumn("w", F.coalesce("w", F.concat(F.lit(" "), F.col("_key").cast("string"))))
    rows = rows.join(F.broadcast(right) if small else right, "w", "left")
    out = rows.groupBy("doc_id", "_key").agg(
        F.first("n_words").alias("n_words"),
        F.first("_hits").alias("_hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.collect_set(F.when(F.col("items").isNotNull(), F.col("w"))).alias("_ok"),
        F.count_if(F.coalesce(F.col("k"), F.lit(0)) == 0).alias("copies"),
    )
    # a hash may be right by chance: only windows that the join has confirmed count
    out = out.withColumn("_hits", F.when(F.size("_ok") == 0, F.array().cast("array<struct<n:int,at:int,w:string>>")).otherwise(F.filter("_hits", lambda c: F.array_contains("_ok", c["w"]))))
    out = out.select("doc_id", "n_words", _covered("_hits").alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))).alias("_one"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", (F.col("n_hit") > 0).alias("contaminated"))


def clean(docs: DataFrame, items: DataFrame, n: int = 10, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", remove: str = "documents") -> DataFrame:
    """``docs`` without contaminated documents, or (remove="spans") without the hit words and the gaps before them."""
    if remove not in ("documents", "spans"):
        raise ValueError(remove)
    given, text_col = docs.columns, f"c{docs.columns.index(text_col)}"
    docs = plain(docs)
    names = docs.columns
    rows, windows = judged(docs, items, n, text_col, item_id, item_text)
    rows = rows.select(*names, "_hits", F.xxhash64(*names).alias("_key"))
    if windows.limit(SET_WINDOWS + 1).count() <= SET_WINDOWS:
        spelled = [r["w"] for r in windows.select("w").collect()]  # at most SET_WINDOWS rows
        rows = rows.withColumn("_hits", F.filter("_hits", lambda c: c["w"].isin(spelled)) if spelled else F.array().cast("array<struct<n:int,at:int,w:string>>"))
    else:
        # rows of equal key may share what is confirmed: each still looks up its own words in it
        said = rows.select("_key", F.explode_outer(F.array_distinct(F.transform("_hits", lambda c: c["w"]))).alias("w")).distinct()
        ok = said.join(windows.select("w").distinct(), "w", "left_semi").groupBy("_key").agg(F.collect_set("w").alias("_ok"))
        rows = rows.join(ok, "_key", "left").withColumn("_hits", F.filter("_hits", lambda c: F.array_contains(F.coalesce("_ok", F.array().cast("array<string>")), c["w"])))
    if remove == "documents":
        # through a generator, below which no filter moves: there it would repeat the hashes for each use of them
        clean_rows = rows.select(*names, F.explode(F.array(F.size("_hits"))).alias("_n"))
        return clean_rows.where("_n = 0").select(*names).toDF(*given)
    pieces = F.regexp_extract_all(F.col(text_col), F.lit(GAP + WORD), F.lit(0))
    left = F.filter(pieces, lambda p, i: ~F.exists("_hits", lambda c: (i >= c["at"]) & (i < c["at"] + c["n"])))
    text = F.concat(F.array_join(left, ""), F.regexp_extract(F.col(text_col), GAP + "$", 0))
    return rows.select(*[F.when(F.size("_hits") > 0, text).otherwise(F.col(c)).alias(c) if c == text_col else c for c in names]).toDF(*given)
