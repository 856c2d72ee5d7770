"""DOCX documents as ordered blocks.

Files are read by Spark's binaryFile source, so any path that Spark can read
will do; each is unzipped and parsed in the task that holds it. A document is
the unit of parallelism. ``spark.read.format("docx")`` (after ``register``) gives
the same blocks and opens only the files that filters on ``doc_id`` leave.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from fnmatch import fnmatchcase
from pathlib import PurePosixPath
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringEndsWith, StringStartsWith

from ..errors import EmptyDocumentError, FileParseError
from ..operators.chunking import BLOCKS, chunk_blocks

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _text(node: ET.Element) -> str:
    out = []
    for x in node.iter():
        if x.tag == f"{W}t":
            out.append(x.text or "")
        elif x.tag == f"{W}tab":
            out.append("\t")
        elif x.tag in (f"{W}br", f"{W}cr"):
            out.append("\n")
    return "".join(out)


def _table(node: ET.Element) -> list[list[str]]:
    """Cell texts; a merged cell counts once for each place it covers."""
    rows: list[list[str]] = []
    for tr in node.findall(f"{W}tr"):
        row: list[str] = []
        for tc in tr.findall(f"{W}tc"):
            pr = tc.find(f"{W}tcPr")
            span = pr.find(f"{W}gridSpan") if pr is not None else None
            merge = pr.find(f"{W}vMerge") if pr is not None else None
            text = "\n".join(_text(p) for p in tc.findall(f"{W}p"))
            if merge is not None and merge.get(f"{W}val", "continue") != "restart" and rows and len(row) < len(rows[-1]):
                text = rows[-1][len(row)]
            row += [text] * int(span.get(f"{W}val", "1") if span is not None else 1)
        rows.append(row)
    return rows


def blocks_of(content: bytes) -> list[tuple]:
    """(block_idx, kind, style, has_numpr, text, table_data) of the paragraphs and tables of the body, in order."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ET.fromstring(z.read("word/document.xml")).find(f"{W}body")
        styles = {}
        if "word/styles.xml" in z.namelist():
            for s in ET.fromstring(z.read("word/styles.xml")).findall(f"{W}style"):
                name = s.find(f"{W}name")
                styles[s.get(f"{W}styleId")] = name.get(f"{W}val") if name is not None else s.get(f"{W}styleId")
    out, i = [], 0
    for node in body if body is not None else ():
        if node.tag == f"{W}p":
            i += 1
            pr = node.find(f"{W}pPr")
            style = pr.find(f"{W}pStyle") if pr is not None else None
            name = styles.get(style.get(f"{W}val"), style.get(f"{W}val")) if style is not None else None
            out.append((i, "paragraph", name, pr is not None and pr.find(f"{W}numPr") is not None, _text(node), None))
        elif node.tag == f"{W}tbl":
            i += 1
            out.append((i, "table", None, False, None, _table(node)))
    return out


def _rows(path: str, content: bytes) -> list[tuple]:
    """BLOCKS of one file; one block of kind error if it cannot be parsed."""
    try:
        return [(path, *b) for b in blocks_of(content)]
    except Exception as e:
        return [(path, 0, "error", None, False, str(e)[:200], None)]


def read_blocks(spark: SparkSession, *paths: str) -> DataFrame:
    """BLOCKS of DOCX files; doc_id is the path. A file that cannot be parsed gives one block of kind error."""
    files = spark.read.format("binaryFile").load(list(paths)).select("path", "content")
    columns = ["doc_id", "block_idx", "kind", "style", "has_numpr", "text", "table_data"]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                yield pd.DataFrame(_rows(path, content), columns=columns)

    return files.mapInPandas(parse, BLOCKS)


@dataclass
class Files(InputPartition):
    """Files that one task reads: doc_id and path in their file system."""

    files: tuple[tuple[str, str], ...]


class DocxReader(DataSourceReader):
    """Lists names and sizes when planned; files are opened in the tasks.

    Filters on doc_id (equal, one of, begins with, ends with) are applied to the list, all others are left to Spark.
    """

    def __init__(self, path: str, partition_bytes: int):
        self.path, self.partition_bytes = path, partition_bytes
        self.wanted: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, EqualTo | In | StringStartsWith | StringEndsWith) and f.attribute == ("doc_id",):
                self.wanted.append(f)
            else:
                yield f

    def _keeps(self, doc_id: str) -> bool:
        tests = {EqualTo: lambda v: doc_id == v, In: lambda v: doc_id in v, StringStartsWith: doc_id.startswith, StringEndsWith: doc_id.endswith}
        return all(tests[type(f)](f.value) for f in self.wanted)

    def partitions(self) -> list[Files]:
        system, at = _file_system(self.path)
        root = "file:" if system.type_name == "local" else self.path.removesuffix(at)
        out: list[Files] = []
        part, load = [], 0
        for path, size in sorted(_listed(system, at)):
            if not self._keeps(root + path):
                continue
            if part and load + size > self.partition_bytes:
                out.append(Files(tuple(part)))
                part, load = [], 0
            part.append((root + path, path))
            load += size
        return [*out, Files(tuple(part))]

    def read(self, partition: Files) -> Iterator[tuple]:
        system, _ = _file_system(self.path)
        for doc_id, path in partition.files:
            with system.open_input_stream(path) as f:
                content = f.read()
            yield from _rows(doc_id, content)


def _file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _listed(system, at: str) -> Iterator[tuple[str, int]]:
    """(path, size) of a file, of the files of a folder, or of those whose name fits a pattern; hidden ones aside, as Spark does."""
    from pyarrow import fs

    folder, pattern = at, "*"
    info = system.get_file_info(at)
    if info.type == fs.FileType.File:
        yield info.path, info.size
        return
    if info.type == fs.FileType.NotFound:
        folder, _, pattern = at.rpartition("/")
        if not set("*?[") & set(pattern):
            raise FileNotFoundError(at)
    for x in system.get_file_info(fs.FileSelector(folder or "/")):
        if x.type == fs.FileType.File and x.base_name[0] not in "._" and fnmatchcase(x.base_name, pattern):
            yield x.path, x.size


class Docx(DataSource):
    """Format "docx": BLOCKS of a file, a folder or a pattern of names.

    Options: partition_bytes, the size of the files that one task reads (16 MB); a larger file is a task of its own.
    """

    @classmethod
    def name(cls) -> str:
        return "docx"

    def schema(self) -> str:
        return BLOCKS

    def reader(self, schema) -> DocxReader:
        return DocxReader(self.options["path"], int(self.options.get("partition_bytes", 16 << 20)))


def register(spark: SparkSession) -> None:
    """Makes spark.read.format("docx") known to a session, with its filters pushed to the list of files."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Docx)


def check_type(path: str, file_type: str | None = None) -> str:
    kind = (file_type or PurePosixPath(path).suffix.lstrip(".")).lower()
    if kind != "docx":
        raise ValueError(f"Unsupported file type: {kind or 'none'}")
    return kind


def parse_and_chunk(spark: SparkSession, path: str, file_type: str | None = None, most: int = 3000, least: int = 50) -> tuple[DataFrame, DataFrame]:
    """Chunks and statistics of one document or a folder of them."""
    check_type(path, file_type)
    try:
        blocks = read_blocks(spark, path)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            raise FileNotFoundError(path) from e
        raise
    bad = blocks.where("kind = 'error'").select("doc_id", "text").first()
    if bad:
        raise FileParseError(f"{bad['doc_id']}: {bad['text']}")
    chunks, stats = chunk_blocks(blocks, most, least)
    if not chunks.limit(1).count():
        raise EmptyDocumentError(path)
    return chunks, stats


def with_file(stats: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row per document: path, type, number of chunks, statistics."""
    n = chunks.groupBy("doc_id").agg(F.count("*").alias("total_chunks"))
    return n.join(stats, "doc_id").withColumns({"file_path": F.col("doc_id"), "file_type": F.lit("docx")})
