"""Documents to chunks: block state machine, packing, table splits, batches.

Order is data: every input has a position column, every output gets one. Folds over the rows of a
document (packs of lines, batches of chunks) stream: no document is gathered into one row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import dims
from ..functions.ids import chunk_id
from ..functions.text import clean_paragraph, normalize_text, starts_with_any

#: Rows that a streamed fold takes and gives at once.
SENT = 4096
#: Text that one task of the block state machine takes, unless one document has more.
TASK_BYTES = 16 << 20
ARROW = {"int": pa.int32(), "long": pa.int64(), "bigint": pa.int64(), "string": pa.string()}
BLOCKS = "doc_id string, block_idx int, kind string, style string, has_numpr boolean, text string, table_data array<array<string>>"


def line_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, pos, text): the lines of each text, from 1."""
    lines = F.posexplode(F.split(docs[text_col], "\n"))
    return docs.select(docs[id_col].alias("doc_id"), lines.alias("pos", "text")).withColumn("pos", F.col("pos") + 1)


def pack(blocks: Column, most: int, joint: str = "\n\n") -> Column:
    """Greedy packs of an array of texts, in order: array of struct(text, first, last).

    A pack takes blocks while its length, joints included, stays within ``most``; no block is split.
    """
    n = len(joint)
    kind = "struct<packs:array<struct<first:int,last:int>>,size:int,first:int,i:int>"
    zero = F.struct(F.array().cast("array<struct<first:int,last:int>>").alias("packs"), F.lit(0).alias("size"), F.lit(0).alias("first"), F.lit(0).alias("i")).cast(kind)

    def step(s: Column, size: Column) -> Column:
        held = s["i"] > s["first"]
        add = size + F.when(held, n).otherwise(0)
        full = held & (s["size"] + add > most)
        done = F.when(full, F.concat(s["packs"], F.array(F.struct(s["first"].alias("first"), s["i"].alias("last"))))).otherwise(s["packs"])
        return F.struct(done.alias("packs"), F.when(full, size).otherwise(s["size"] + add).cast("int").alias("size"), F.when(full, s["i"]).otherwise(s["first"]).alias("first"), (s["i"] + 1).alias("i"))

    end = lambda s: F.when(s["i"] > s["first"], F.concat(s["packs"], F.array(F.struct(s["first"].alias("first"), s["i"].alias("last"))))).otherwise(s["packs"])
    cuts = F.aggregate(F.transform(blocks, lambda b: F.length(b)), zero, step, end)
    return F.transform(cuts, lambda c: F.struct(F.array_join(F.slice(blocks, c["first"] + 1, c["last"] - c["first"]), joint).alias("text"), (c["first"] + 1).alias("first"), c["last"].alias("last")))


def folded(rows: DataFrame, keys: tuple[str, ...], order: list[str], fold: Callable[[Iterator[tuple]], Iterator[tuple]], schema: str) -> DataFrame:
    """``fold`` over the rows of each key, in order, as they pass: the keys and what it gives for the other columns.

    Rows are dealt by key and sorted within their partitions, so a key of any size streams through one task that holds what the fold holds.
    """
    rest = [c for c in rows.columns if c not in keys]
    rows = rows.select(*keys, *rest).repartition(*keys).sortWithinPartitions(*keys, *order)
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    names, told = [*keys, *(x.split()[0] for x in schema.split(", "))], [ARROW.get(x.split()[1]) for x in schema.split(", ")]
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.DataType] = []

        def each() -> Iterator[tuple]:
            for batch in batches:
                kept[:] = [batch.schema.field(k).type for k in range(n)]
                for a in range(0, batch.num_rows, SENT):
                    yield from zip(*(c.to_pylist() for c in batch.slice(a, SENT).columns))

        groups = groupby(each(), lambda r: r[:n])
        found = ((*key, *out) for key, group in groups for out in fold(r[n:] for r in group))
        while part := list(islice(found, SENT)):
            columns = list(zip(*part))
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(columns, [*kept, *told])], names)

    return rows.mapInArrow(run, f"{kinds}, {schema}")


def pack_blocks(blocks: DataFrame, most: int = dims.CHUNK_MAX, keys: tuple[str, ...] = ("doc_id",), pos: str = "pos", text: str = "text") -> DataFrame:
    """Packs the ordered blocks of each key: keys, position, content_text. A task holds one open pack."""

    def fold(rows: Iterator[tuple]) -> Iterator[tuple]:
        held, size, at = [], 0, 1
        for _, block in rows:
            add = len(block) + (2 if held else 0)
            if held and size + add > most:
                yield at, "\n\n".join(held)
                held, size, at, add = [], 0, at + 1, len(block)
            held.append(block)
            size += add
        yield at, "\n\n".join(held)

    rows = blocks.select(*keys, F.col(pos).alias("_pos"), F.coalesce(text, F.lit("")).alias("_text"))
    return folded(rows, keys, ["_pos", "_text"], fold, "position int, content_text string")


def table_text(table: Column) -> Column:
    """Cells by tabs, rows by line breaks."""
    return F.array_join(F.transform(table, lambda r: F.array_join(r, "\t", "")), "\n")


def table_rows(table: Column) -> Column:
    """Normalised cells without wholly blank rows."""
    cells = F.transform(table, lambda r: F.transform(r, lambda c: normalize_text(F.coalesce(c, F.lit("")))))
    return F.filter(cells, lambda r: F.exists(r, lambda c: F.trim(c) != ""))


def split_table(table: Column, most: int) -> Column:
    """Row ranges of a table as array of struct(table, start, end); the header is repeated in each.

    A part takes rows while its text stays within ``most``, and at least one.
    """
    size = lambda r: F.length(F.array_join(r, "\t", ""))
    header = table[0]
    kind = "struct<parts:array<struct<a:int,b:int>>,size:int,a:int,i:int>"
    zero = F.struct(F.array().cast("array<struct<a:int,b:int>>").alias("parts"), size(header).alias("size"), F.lit(1).alias("a"), F.lit(1).alias("i")).cast(kind)

    def step(s: Column, n: Column) -> Column:
        full = (s["i"] > s["a"]) & (s["size"] + 1 + n > most)
        done = F.when(full, F.concat(s["parts"], F.array(F.struct(s["a"].alias("a"), s["i"].alias("b"))))).otherwise(s["parts"])
        return F.struct(done.alias("parts"), F.when(full, size(header) + 1 + n).otherwise(s["size"] + 1 + n).cast("int").alias("size"), F.when(full, s["i"]).otherwise(s["a"]).alias("a"), (s["i"] + 1).alias("i"))

    body = F.slice(table, 2, F.greatest(F.size(table) - 1, F.lit(0)))
    cuts = F.aggregate(F.transform(body, size), zero, step, lambda s: F.concat(s["parts"], F.array(F.struct(s["a"].alias("a"), s["i"].alias("b")))))
    return F.transform(
        cuts,
        lambda c: F.struct(F.concat(F.array(header), F.slice(table, c["a"] + 1, c["b"] - c["a"])).alias("table"), c["a"].alias("start"), F.greatest(c["b"] - 1, c["a"]).alias("end")),
    )


def is_key_value(table: Column) -> Column:
    """Two columns, and a first row of an identifier or of a field/value header."""
    k, v = F.lower(F.trim(table[0][0])), F.lower(F.trim(F.get(table[0], F.lit(1))))
    wide = F.array_max(F.transform(table, lambda r: F.size(r))) == 2
    named = k.endswith(" id") | (k.isin("field", "attribute", "name") & v.isin("value", "values"))
    return F.coalesce((F.size(table) >= 2) & wide & (k != "") & (v != "") & named, F.lit(False))


def is_control_table(table: Column) -> Column:
    return F.coalesce(F.exists(table[0], lambda c: F.contains(F.lower(c), F.lit("control id")) | F.contains(F.lower(c), F.lit("control code"))), F.lit(False))


def heading_entity(heading: Column) -> Column:
    """Struct of record_type and record_id, or null."""
    letter = F.upper(F.regexp_extract(heading, r"(?i)^([PRC])-(\d{3})\b", 1))
    number = F.regexp_extract(heading, r"(?i)^([PRC])-(\d{3})\b", 2)
    kinds = F.create_map(*[F.lit(x) for kv in dims.RECORD_PREFIXES.items() for x in kv])
    return F.when(letter != "", F.struct(kinds[letter].alias("record_type"), F.concat_ws("-", letter, number).alias("record_id")))


def table_entity(table: Column) -> Column:
    k, v = F.lower(F.trim(F.coalesce(table[0][0], F.lit("")))), F.trim(F.get(table[0], F.lit(1)))
    out = F.lit(None).cast("struct<record_type:string,record_id:string>")
    for letter, kind in dims.RECORD_PREFIXES.items():
        out = F.when((k == f"{kind} id") & v.startswith(f"{letter}-"), F.struct(F.lit(kind).alias("record_type"), v.alias("record_id"))).otherwise(out)
    return out


def is_fragment(text: Column) -> Column:
    """The first sentence starts with a pronoun and goes on."""
    first = F.ltrim(F.regexp_replace(F.substring_index(text, ".", 1), r"\s+$", ""))
    return F.coalesce(starts_with_any(F.lower(first), dims.CHUNK_PRONOUNS), F.lit(False))


def by_size(blocks: DataFrame) -> DataFrame:
    """Blocks dealt by document to as many tasks as their text needs, so that what a task sorts does not grow with the input; few are left to Spark."""
    size = F.octet_length(F.coalesce("text", F.lit(""))) + F.coalesce(F.octet_length(F.array_join(F.flatten("table_data"), "")), F.lit(0))
    tasks = -(-blocks.agg(F.coalesce(F.sum(size), F.lit(0)).alias("n")).first()["n"] // TASK_BYTES)
    return blocks.repartition(tasks, "doc_id") if tasks > int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")) else blocks


def chunk_blocks(blocks: DataFrame, most: int = dims.CHUNK_MAX, least: int = dims.CHUNK_MIN) -> tuple[DataFrame, DataFrame]:
    """Chunks and statistics of documents given as ordered BLOCKS.

    Headings end what is open and name what follows; paragraphs of one kind are
    gathered until the kind changes and packed; lists are one chunk; tables are
    split by rows unless they are key-value records. A chunk below ``least``
    characters is counted and dropped. The entity of a heading goes to the first
    content after it (a list that is too short passes it on), that of a table
    comes from its first row. Locations name the block that ended the chunk.
    Blocks are sorted once by place and segments once by number; all windows follow these two orders.
    """
    by_doc = Window.partitionBy("doc_id").orderBy("block_idx")
    back = by_doc.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole_doc = by_doc.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = by_size(blocks)
    style = F.lower(F.coalesce("style", F.lit("")))
    text = clean_paragraph(F.coalesce("text", F.lit("")))
    b = blocks.withColumns({"text": text, "table_data": table_rows(F.coalesce("table_data", F.array().cast("array<array<string>>"))), "last_block": F.max("block_idx").over(whole_doc)})
    b = b.where((F.col("kind") == "table") | ((F.col("text") != "") & ~F.contains(style, F.lit("toc"))))
    kind = F.when(F.col("kind") == "table", "table").when(style.startswith("heading"), "heading").when(F.contains(style, F.lit("list")) | F.coalesce("has_numpr", F.lit(False)), "list").otherwise("prose")
    b = b.withColumn("kind", kind)
    new = (F.col("kind").isin("heading", "table")) | (F.lag("kind").over(by_doc).isNull()) | (F.col("kind") != F.lag("kind").over(by_doc))
    b = b.withColumns({"segment": F.sum(F.when(new, 1).otherwise(0)).over(back), "heading": F.last(F.when(F.col("kind") == "heading", F.col("text")), True).over(back)})
    seg = b.groupBy("doc_id", "segment").agg(
        F.first("kind").alias("kind"), F.first("heading").alias("heading"), F.first("last_block").alias("last_block"),
        F.min("block_idx").alias("first_idx"), F.sort_array(F.collect_list(F.struct("block_idx", "text"))).alias("b"), F.first("table_data").alias("table_data"),
    )
    by_seg = Window.partitionBy("doc_id").orderBy("segment")
    upto, before = by_seg.rowsBetween(Window.unboundedPreceding, Window.currentRow), by_seg.rowsBetween(Window.unboundedPreceding, -1)
    seg = seg.withColumn("flush", F.coalesce(F.lead("first_idx").over(by_seg), F.col("last_block")))
    texts = F.transform("b", lambda x: x["text"])
    seg = seg.withColumn("list_text", F.when(F.col("kind") == "list", normalize_text(F.array_join(texts, "\n"))))
    # what takes the heading away: prose, tables with rows, lists that are long enough; not another heading
    takes = (F.col("kind") == "prose") | ((F.col("kind") == "table") & (F.size("table_data") > 0)) | ((F.col("kind") == "list") & (F.length("list_text") >= least))
    seg = seg.withColumn("takes", takes).withColumn("since", F.sum(F.when(F.col("kind") == "heading", 1).otherwise(0)).over(upto))
    taken = F.coalesce(F.max(F.when(F.col("takes"), F.col("since"))).over(before) == F.col("since"), F.lit(False))  # since the same heading: it never falls
    seg = seg.withColumn("pending", F.when(~taken & (F.col("since") > 0), F.col("heading")))
    numbered = F.sum(F.when((F.col("kind") == "table") & (F.size("table_data") > 0), 1).otherwise(0)).over(upto)
    seg = seg.withColumn("table_no", numbered)
    none = "array<struct<text:string,table:array<array<string>>,location:string>>"
    block = F.concat(F.lit("block "), F.col("flush").cast("string"))
    prose = F.transform(pack(texts, most), lambda p: F.struct(normalize_text(p["text"]).alias("text"), F.lit(None).cast("array<array<string>>").alias("table"), block.alias("location")))
    listed = F.array(F.struct(F.col("list_text").alias("text"), F.lit(None).cast("array<array<string>>").alias("table"), block.alias("location")))
    place = lambda a, z: F.concat(F.lit("table "), F.col("table_no").cast("string"), F.lit(":rows "), a.cast("string"), F.lit("-"), z.cast("string"))
    whole = F.array(F.struct(normalize_text(table_text(F.col("table_data"))).alias("text"), F.col("table_data").alias("table"), place(F.lit(1), F.greatest(F.lit(1), F.size("table_data") - 1)).alias("location")))
    parts = F.transform(split_table(F.col("table_data"), most), lambda t: F.struct(normalize_text(table_text(t["table"])).alias("text"), t["table"].alias("table"), place(t["start"], t["end"]).alias("location")))
    found = (
        F.when(F.col("kind") == "prose", prose.cast(none)).when(F.col("kind") == "list", listed.cast(none))
        .when((F.col("kind") == "table") & (F.size("table_data") > 0), F.when(is_key_value(F.col("table_data")), whole.cast(none)).otherwise(parts.cast(none)))
        .otherwise(F.array().cast(none))
    )
    seg = seg.select("doc_id", "segment", "kind", "heading", "pending", "table_data", found.alias("found"))
    long_enough = lambda c: F.coalesce(F.length(c["text"]) >= least, F.lit(False))
    each = seg.select("doc_id", "segment", "kind", F.explode_outer("found").alias("c")).withColumn("keep", long_enough(F.col("c")))
    stats = each.groupBy("doc_id").agg(
        F.count_distinct(F.when((F.col("kind") == "table") & F.col("c").isNotNull(), F.col("segment"))).alias("table_count"),
        F.count_if((F.col("kind") == "prose") & F.col("keep")).alias("prose_sections"),
        F.count_if(F.col("kind") == "heading").alias("heading_count"),
        F.count_if((F.col("kind") == "list") & F.col("keep")).alias("list_sections"),
        F.coalesce(F.sum(F.when(F.col("keep"), F.length("c.text"))), F.lit(0)).alias("total_chars"),
        F.count_if(F.col("c").isNotNull() & ~F.col("keep")).alias("empty_chunks_skipped"),
    )
    entity = F.when(F.col("kind") == "table", table_entity(F.col("c.table"))).otherwise(heading_entity(F.col("pending")))
    stub = (F.col("kind") == "prose") & heading_entity(F.col("pending")).isNotNull() & F.col("c.text").rlike(dims.STUB_PATTERN)
    fragment = (F.col("kind") == "prose") & is_fragment(F.col("c.text"))
    notes = F.struct(
        entity["record_type"].alias("record_type"), entity["record_id"].alias("record_id"), F.coalesce(stub, F.lit(False)).alias("incomplete_record"),
        F.when(stub, "stub_control_reference_only").alias("incomplete_reason"), F.coalesce(fragment, F.lit(False)).alias("fragment_warning"),
        F.when(fragment, "starts_with_pronoun_no_antecedent").alias("fragment_reason"),
    )
    kept = seg.withColumn("kept", F.filter("found", long_enough)).withColumn("earlier", F.coalesce(F.sum(F.size("kept")).over(before), F.lit(0)))
    chunks = kept.select("doc_id", "kind", "heading", "pending", "earlier", F.posexplode("kept").alias("part", "c")).withColumn("position", (F.col("earlier") + F.col("part")).cast("int"))
    chunks = chunks.select(
        "doc_id", "position", chunk_id(F.col("doc_id"), F.col("position"), F.col("c.text")).alias("chunk_id"), F.col("kind").alias("chunk_type"), F.col("c.text").alias("content_text"),
        F.col("c.table").alias("table_data"), F.size("c.table").alias("row_count"), F.array_max(F.transform("c.table", lambda r: F.size(r))).alias("col_count"),
        F.col("c.location").alias("source_location"), F.col("heading").alias("parent_heading"), F.length("c.text").alias("char_count"), notes.alias("annotations"),
    )
    return chunks, stats


def build_batches(chunks: DataFrame, key: str = "doc_id", record_type: str = "record_type", pos: str = "position", size: str = "char_count", budget: int = dims.BATCH_CHARS) -> DataFrame:
    """(key, batch_id, ord, pos): chunks of each key in batches within the budget.

    Annotated chunks come first, by record type; a chunk over the budget is a
    batch of its own; a batch that follows a full one starts with its last chunk.
    """
    rows = chunks.select(
        key, F.col(record_type).isNull().alias("_other"), F.coalesce(record_type, F.lit("")).alias("_kind"), F.col(pos).cast("long").alias("_pos"), F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("_size"),
    )

    def fold(rows: Iterator[tuple]) -> Iterator[tuple]:
        held, total, last, at = [], 0, 0, 0
        for _, _, one, n in rows:
            if held and (n > budget or total + n > budget):
                yield from ((at, i, p) for i, p in enumerate(held))
                at += 1
                held, total = ([], 0) if n > budget else (held[-1:], last)
            if n > budget:
                yield at, 0, one
                held, total, last, at = [], 0, 0, at + 1
            else:
                held.append(one)
                total, last = total + n, n
        yield from ((at, i, p) for i, p in enumerate(held))

    return folded(rows, (key,), ["_other", "_kind", "_pos", "_size"], fold, "batch_id int, ord int, pos long")
