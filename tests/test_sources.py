"""Documents in, outputs out, the whole flow, errors, settings, streams."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from clausewright import errors
from clausewright.config import Config
from clausewright.operators import chunking
from clausewright.plans import pipeline
from clausewright.sources import docx, extractor, prompts, sinks
from clausewright.streaming import ingest

NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def write_docx(path, parts):
    def cell(t):
        return f"<w:tc><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:tc>"

    body = ""
    for kind, value in parts:
        if kind == "table":
            body += "<w:tbl>" + "".join("<w:tr>" + "".join(map(cell, r)) + "</w:tr>" for r in value) + "</w:tbl>"
        else:
            style = f'<w:pPr><w:pStyle w:val="{kind}"/></w:pPr>' if kind else ""
            body += f'<w:p>{style}<w:r><w:t xml:space="preserve">{value}</w:t></w:r></w:p>'
    styles = "".join(f'<w:style w:styleId="{i}"><w:name w:val="{n}"/></w:style>' for i, n in (("H1", "heading 1"), ("LB", "List Bullet")))
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f"<w:document {NS}><w:body>{body}</w:body></w:document>")
        z.writestr("word/styles.xml", f"<w:styles {NS}>{styles}</w:styles>")


PARTS = [
    ("H1", "P-001: Records"), ("", "Account records must be kept with an accuracy of at least 99 percent. The bank shall verify balances within 30 days."), ("LB", "Each branch must update its log daily."),
    ("LB", "Reviews should be documented."), ("table", [["Field", "Value"], ["Policy ID", "P-001"], ["Owner", "Compliance"]]), ("table", [["A", "B", "C"], *[[str(i), "x" * 20, "y" * 20] for i in range(30)]]),
]


def test_docx(spark, tmp_path):
    write_docx(tmp_path / "a.docx", PARTS)
    chunks, stats = docx.parse_and_chunk(spark, str(tmp_path / "a.docx"), None, 500, 10)
    got = chunks.orderBy("position").collect()
    assert [r["chunk_type"] for r in got][:3] == ["prose", "list", "table"]
    tables = [r for r in got if r["col_count"] == 3]
    assert len(tables) > 2 and all(r["table_data"][0] == ["A", "B", "C"] and r["char_count"] <= 500 for r in tables)
    assert sum(r["row_count"] - 1 for r in tables) == 30
    assert [r["chunk_id"] for r in docx.parse_and_chunk(spark, str(tmp_path / "a.docx"), None, 500, 10)[0].orderBy("position").collect()] == [r["chunk_id"] for r in got]
    assert docx.with_file(stats, chunks).first()["total_chunks"] == len(got)


def test_docx_format(spark, tmp_path):
    """The format gives the blocks of read_blocks, and opens only the files that filters leave."""
    for k in range(5):
        write_docx(tmp_path / f"d{k}.docx", [*PARTS, ("", f"number {k}")])
    (tmp_path / "b.docx").write_bytes(b"no zip")
    (tmp_path / "_hidden").write_bytes(b"")
    docx.register(spark)
    read = spark.read.format("docx").option("partition_bytes", 1)
    blocks = read.load(str(tmp_path))
    assert blocks.rdd.getNumPartitions() == 6
    key = lambda r: (r["doc_id"], r["block_idx"])
    assert sorted(blocks.collect(), key=key) == sorted(docx.read_blocks(spark, str(tmp_path)).collect(), key=key)
    assert read.load(str(tmp_path / "d[12].docx")).select("doc_id").distinct().count() == 2
    assert read.load(str(tmp_path / "d9*")).count() == 0
    with pytest.raises(Exception, match="FileNotFoundError"):
        read.load(str(tmp_path / "none.docx")).count()
    # what is no file any more fails when it is opened, and only then
    listed = docx.DocxReader(str(tmp_path), 1)
    wanted = f"file:{tmp_path}/d1.docx"
    left = list(listed.pushFilters([docx.EqualTo(("doc_id",), wanted), docx.EqualTo(("kind",), "table")]))
    assert [f.attribute for f in left] == [("kind",)] and [p.files for p in listed.partitions()] == [((wanted, f"{tmp_path}/d1.docx"),)]
    one = blocks.where((F.col("doc_id") == wanted) & (F.col("kind") == "table"))
    assert one.rdd.getNumPartitions() == 1 and one.count() == 2 and {r["doc_id"] for r in one.collect()} == {wanted}
    assert blocks.where(F.col("doc_id").startswith(f"file:{tmp_path}/d")).select("doc_id").distinct().count() == 5
    assert blocks.where(F.col("doc_id").isin(wanted, "x")).select("doc_id").distinct().count() == 1


def test_docx_errors(spark, tmp_path):
    with pytest.raises(ValueError):
        docx.parse_and_chunk(spark, "a.pdf")
    with pytest.raises(FileNotFoundError):
        docx.parse_and_chunk(spark, str(tmp_path / "none.docx"))
    write_docx(tmp_path / "e.docx", [])
    with pytest.raises(errors.EmptyDocumentError):
        docx.parse_and_chunk(spark, str(tmp_path / "e.docx"))
    (tmp_path / "b.docx").write_bytes(b"no zip")
    with pytest.raises(errors.FileParseError):
        docx.parse_and_chunk(spark, str(tmp_path / "b.docx"))


def test_flow(spark, tmp_path):
    write_docx(tmp_path / "a.docx", PARTS)
    run = pipeline.run(docx.read_blocks(spark, str(tmp_path / "a.docx")), most=500, least=10)
    reqs = run.requirements.select("rule_type", "confidence", "grounding_classification", "schema_status", sinks.output_json(run.requirements).alias("j")).collect()
    assert len(reqs) >= 3 and all(r["grounding_classification"] == "EXACT" and 0.5 <= r["confidence"] <= 0.99 for r in reqs)
    published = [json.loads(r["j"]) for r in reqs]
    assert all("source_text" not in p["grounding"] and p["metadata"]["source_chunk_id"].startswith("chunk-") for p in published)
    report = run.report.first()
    assert report["total_requirements"] == len(reqs) and 0 < report["coverage_ratio"] <= 1
    assert run.skipped.count() == 0 and run.gate.first()["decision"] == "human_review"
    sinks.write_requirements(run.requirements, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == len(reqs)
    sinks.write_export(run.requirements, str(tmp_path / "csv"))
    assert spark.read.option("header", True).option("multiLine", True).csv(str(tmp_path / "csv")).columns[0] == "Requirement ID"


RECORDS = [*PARTS[:4], ("table", [["Policy ID", "P-001"], ["Owner", "Compliance"], ["Scope", "The bank shall verify balances within 30 days."]]), PARTS[5]]
COMPONENTS = json.dumps([{"component_id": "P-001", "title": "Records", "related_controls": ["C-001", "C-009"], "related_risks": "R-001; "}])


def test_prompts(spark, tmp_path):
    """Prompts carry instructions, rule types, the schema, and chunks with their line breaks, ids and headings."""
    write_docx(tmp_path / "a.docx", RECORDS)
    run = pipeline.run(docx.read_blocks(spark, str(tmp_path / "a.docx")), most=500, least=10)
    asked = run.prompts.orderBy("batch_id").collect()
    text = "\n".join(r["prompt"] for r in asked)
    assert all("Return a JSON array" in r["prompt"] and "update_timeline" in r["prompt"] and "Schema of the document (format docx)" in r["prompt"] and "{schema}" not in r["prompt"] for r in asked)
    assert {r["temperature"] for r in asked} == {0.1} and "Heading: " in text and "Location: " in text
    for c in run.chunks.collect():
        assert f"=== CHUNK [{c['chunk_id']}] {c['chunk_type'].upper()}" in text and c["content_text"] in text  # whole, line breaks and all
    assert any("\n" in c["content_text"] for c in run.chunks.collect())
    parts = prompts.component_prompts(pipeline.flat_chunks(run.chunks), run.gate).collect()
    assert [r["record_type"] for r in parts] == ["policy"] and "Record type: policy" in parts[0]["prompt"] and "P-001" in parts[0]["prompt"]
    assert "first pass" in prompts.load("requirements", prompts.version_of(2)) and prompts.temperature_of(2) == 0.0
    (tmp_path / "requirements").mkdir()
    (tmp_path / "requirements" / "v1.0.yaml").write_text("system: 'Own words. {schema} End.'\n")
    own = prompts.requirement_prompts(run.members, pipeline.flat_chunks(run.chunks), run.gate, folder=str(tmp_path)).first()["prompt"]
    assert own.startswith("Own words. Schema of the document") and " End.\n\n=== CHUNK [" in own
    with pytest.raises(KeyError):
        prompts.load("nothing")


def test_flow_with_recorded_responses(spark, tmp_path):
    """From blocks to the published object with responses as a model gives them: components, links, skips, second pass."""
    write_docx(tmp_path / "a.docx", RECORDS)
    blocks = docx.read_blocks(spark, str(tmp_path / "a.docx"))

    def components(prompt):
        assert "You read governance records" in prompt and "Schema of the document" in prompt
        return "Here they are: " + COMPONENTS

    def answer(prompt, temperature):
        ids = [m[1] for m in extractor.HEAD.finditer(prompt)]
        said = "The bank shall verify balances within 30 days."
        if "first pass" in prompt:
            assert temperature == 0.0
            return json.dumps([{"rule_type": "update_timeline", "rule_description": said, "grounded_in": said, "confidence": 0.9, "attributes": {"timeline": "30 days"}, "source_chunk_id": i} for i in ids if "record: POLICY" in prompt])
        assert temperature == 0.1
        return json.dumps([{"rule_type": "update_timeline", "rule_description": said, "grounded_in": said, "confidence": 0.9, "attributes": {}, "source_chunk_id": ids[0]}, {"rule_type": "no such type"}])

    config = Config()
    config.values = {**config.values, "preprocessing": {"max_chunk_chars": 500, "min_chunk_chars": 10}, "atomizer": {**config.values["atomizer"], "batch_processing": {**config.values["atomizer"]["batch_processing"], "max_batch_chars": 600}}}
    run = pipeline.run(blocks, answer, component_extractor=components, config=config)
    assert run.members.select("batch_id").distinct().count() > 1
    found = run.components.collect()
    assert [(r["component_id"], r["component_type"], r["related_controls"]) for r in found] == [("P-001", "policy", ["C-001", "C-009"])] and found[0]["source_chunk_id"]
    assert {r["message"] for r in run.missing_references.collect()} == {f"Policy P-001 references missing {k}" for k in ("control C-001", "control C-009", "risk R-001")}
    linked = run.requirements.where(F.col("source_chunk_id") == found[0]["source_chunk_id"]).collect()
    assert all(r["parent_component_id"] == "P-001" for r in linked)
    value = json.loads(run.payload().first()["value"])
    assert list(value) == ["extraction_metadata", "gate_decision", "summary", "insights", "skipped_chunks", "requirements"]
    n = run.requirements.count()
    assert len(value["requirements"]) == value["summary"]["total_requirements"] == value["extraction_metadata"]["total_requirements_extracted"] == n > 0
    assert value["gate_decision"]["decision"] == "human_review" and value["summary"]["by_rule_type"] == {"update_timeline": n} and sum(value["summary"]["automation_breakdown"].values()) == n
    assert value["extraction_metadata"]["total_chunks_processed"] == run.chunks.count()
    assert run.requirements.first()["prompt_version"] == "v1.0"
    again = pipeline.second_pass(pipeline.replace(run, report=run.report.withColumn("is_retryable", F.lit(True))), blocks, answer, config=config, component_extractor=components)
    kept = again.requirements.collect()
    assert all(r["extraction_iteration"] == 2 and r["prompt_version"] == "v1.0_retry" and r["confidence"] >= 0.7 for r in kept)
    assert again.report.count() == 1 and {r["skip_reason"] for r in again.skipped.collect()} <= {"no_extractable_content"}
    assert pipeline.second_pass(pipeline.replace(run, report=run.report.withColumn("is_retryable", F.lit(False))), blocks).requirements is run.requirements


def test_schemas_by_model_and_cache(spark, tmp_path):
    """A model describes two documents and fails at one, which statistics describe; a second run asks about that one and new ones only."""
    for name in ("one", "two", "bad"):
        write_docx(tmp_path / f"{name}.docx", [*RECORDS, ("", f"The bank must keep the ledger of {name} for five years.")])
    flat = pipeline.flat_chunks(chunking.chunk_blocks(docx.read_blocks(spark, str(tmp_path)), 500, 10)[0])
    asked = spark.sparkContext.accumulator(0)
    fields = [{"raw_label": "Owner", "inferred_type": "enum", "confidence": 0.9, "example_values": ["x"]}, {"raw_label": " "}, {"raw_label": "Scope", "confidence": 7}]

    def describe(prompt):
        asked.add(1)
        assert prompt.startswith("You describe") and "POLICY" in prompt.upper()
        if "ledger of bad" in prompt:
            return "I cannot"
        return "```json\n" + json.dumps({"entities": [{"discovered_label": "POLICY", "record_count": -3, "fields": fields}, {"record_count": 2}], "relationships": []}) + "\n```"

    cache = str(tmp_path / "cache")
    seen = {r["doc_id"]: r for r in pipeline.read_schemas(flat, describe, cache).collect()}
    assert asked.value == 3 and spark.read.parquet(cache).count() == 2 and len(seen) == 3
    one, bad = (next(r for k, r in seen.items() if name in k) for name in ("one", "bad"))
    assert [(e["discovered_label"], e["record_count"], [(f["raw_label"], f["inferred_type"], f["confidence"]) for f in e["fields"]]) for e in one["entities"]] == [("POLICY", 0, [("Owner", "enum", 0.9), ("Scope", "text", 0.5)])]
    assert one["avg_confidence"] == 0.7 and bad["avg_confidence"] == 0.5 and bad["entities"][0]["record_count"] == 1

    def recorded(prompt):
        assert "ledger of bad" in prompt or "ledger of new" in prompt
        return describe(prompt)

    write_docx(tmp_path / "new.docx", [*RECORDS, ("", "The bank must keep the ledger of new for five years.")])
    more = pipeline.flat_chunks(chunking.chunk_blocks(docx.read_blocks(spark, str(tmp_path)), 500, 10)[0])
    again = {r["doc_id"]: r["schema_version"] for r in pipeline.read_schemas(more, recorded, cache).collect()}
    assert asked.value == 5 and len(again) == 4 and all(again[k] == r["schema_version"] for k, r in seen.items())
    assert pipeline.read_schemas(flat.where("doc_id NOT LIKE '%bad%'"), lambda p: 1 / 0, cache).count() == 2


def test_second_pass_of_some(spark, tmp_path):
    """Three documents with the same sentences, one read again: numbers repeat between documents, counts are those of each."""
    for name in "abc":
        write_docx(tmp_path / f"{name}.docx", PARTS)
    blocks = docx.read_blocks(spark, str(tmp_path))
    first = pipeline.run(blocks, most=500, least=10)
    assert len({tuple(r)[1:] for r in first.requirements.select("doc_id", "req_no", "rule_description").collect()}) * 3 == first.requirements.count()
    retried = first.report.withColumn("is_retryable", F.col("doc_id").contains("b.docx"))
    again = pipeline.second_pass(pipeline.replace(first, report=retried), blocks, most=500, least=10)
    count = lambda run: {r["doc_id"]: (r["total_requirements"], r["duplicate_pairs"], r["dedup_ratio"], r["coverage_ratio"]) for r in run.report.collect()}
    before, after = count(first), count(again)
    assert len(set(before.values())) == 1 and all(after[k] == v for k, v in before.items() if "b.docx" not in k)
    # the second pass asks for a confidence of 0.70
    strong = first.requirements.where(F.col("doc_id").contains("b.docx") & (F.col("confidence") >= 0.7)).count()
    assert {(v[0], v[1]) for k, v in after.items() if "b.docx" in k} == {(strong, next(iter(before.values()))[1])}
    assert {r["doc_id"][-6:]: r["extraction_iteration"] for r in again.report.collect()} == {"a.docx": 1, "b.docx": 2, "c.docx": 1}


def test_command_line_extractors(tmp_path, monkeypatch):
    """Extractors by name, with retries and tokens from the settings."""
    (tmp_path / "own_calls.py").write_text("def call(prompt, temperature, max_tokens):\n    return f'{prompt} {temperature} {max_tokens}'\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    assert extractor.named("own_calls:call", 1, 0.0, 77)("p", temperature=0.5) == "p 0.5 77"
    assert extractor.named(None, 1, 0.0) is None
    with pytest.raises(ValueError, match="No extractor own_calls:absent"):
        extractor.named("own_calls:absent", 1, 0.0)


def test_gate_of_schemas(spark, tmp_path):
    """No schema: rejected. Fields of the discovered confidence: review. Entities without fields: rejected at 0. Settings move the thresholds."""
    write_docx(tmp_path / "plain.docx", [("", "The bank must keep records of all balances.")])
    write_docx(tmp_path / "fields.docx", PARTS)
    read = docx.read_blocks(spark, str(tmp_path))
    run = pipeline.run(read, most=500, least=10)
    told = {r["doc_id"]: (r["decision"], r["failing_checks"]) for r in run.gate.collect()}
    plain, fields = (next(v for k, v in told.items() if name in k) for name in ("plain", "fields"))
    assert plain == ("reject", ["no_schema_map"]) and fields == ("human_review", [])
    assert all("fields" in r["doc_id"] for r in run.requirements.select("doc_id").collect())
    bare = run.schema.withColumn("avg_confidence", F.lit(0.0))
    assert {r["decision"] for r in pipeline.run(read, most=500, least=10, schema=bare).gate.collect()} == {"reject"}
    (tmp_path / "c.yaml").write_text("confidence_gate: {thresholds: {docx: {auto_accept: 0.4, human_review: 0.2}}}\natomizer: {confidence_thresholds: {pass1: 0.99}, fragment_detection: {pronouns: ['the bank']}}\n")
    moved = pipeline.run(read, most=500, least=10, config=Config(tmp_path / "c.yaml"))
    assert {r["decision"] for r in moved.gate.collect()} == {"accept", "reject"}
    assert moved.requirements.where("confidence < 0.99").count() == 0


def test_replay_and_remote(spark):
    prompts = spark.createDataFrame([(1, "a"), (2, "b")], "k int, prompt string")
    recorded = spark.createDataFrame([(1, "[]")], "k int, content string")
    assert {r["k"]: r["error"] for r in extractor.replay(prompts, recorded, "k").collect()} == {1: None, 2: "NOT_RECORDED"}

    def fail(prompt):
        raise RuntimeError("401 authentication")

    assert {r["error"] for r in extractor.extract(prompts, extractor.remote(fail), "k").collect()} == {"AUTH_FAILED"}


def test_retries():
    tries, waits = [], []

    def call():
        tries.append(1)
        if len(tries) < 3:
            raise RuntimeError("529 overloaded")
        return "ok"

    assert errors.with_retries(call, sleep=waits.append) == "ok" and waits == [1.0, 2.0]
    kinds = [errors.classify(RuntimeError(t)).error_type for t in ("Overloaded", "429", "403", "cannot parse", "timeout")]
    assert kinds == ["API_OVERLOADED", "RATE_LIMIT", "AUTH_FAILED", "INVALID_RESPONSE", "RuntimeError"]
    assert errors.classify(RuntimeError("connection reset")).is_retryable


def test_error_class(spark):
    df = spark.createDataFrame([("HTTP 429",), ("connection lost",)], "t string").select(errors.error_class(F.col("t")).alias("x"))
    assert [(r["x"]["error_type"], r["x"]["is_retryable"]) for r in df.collect()] == [("RATE_LIMIT", True), ("OTHER", True)]


def test_files(spark, tmp_path):
    (tmp_path / "requirements_Some_File_20260223_170219_1b9e96d0.json").write_text('{"a": 1}')
    (tmp_path / "other.json").write_text("{}")
    names = [r["filename"] for r in sinks.list_outputs(spark, str(tmp_path)).collect()]
    assert names == ["requirements_Some_File_20260223_170219_1b9e96d0.json"]
    assert sinks.read_output(spark, str(tmp_path), names[0]).first()["a"] == 1
    with pytest.raises(PermissionError):
        sinks.read_output(spark, str(tmp_path), "../x.json")
    m = spark.createDataFrame([(names[0],)], "f string").select(sinks.manifest_entry(F.col("f")).alias("m")).first()["m"]
    assert (m["label"], m["timestamp"]) == ("Some File - 2026-02-23 17:02", "2026-02-23T17:02:00")
    assert sinks.run_name("chunks", "x/y.docx", tag="t").startswith("chunks_y_")


def test_upsert_and_cache(spark, tmp_path):
    a, b = spark.createDataFrame([("1", "old"), ("2", "old")], "requirement_id string, v string"), spark.createDataFrame([("2", "new"), ("3", "new")], "requirement_id string, v string")
    assert {r["requirement_id"]: r["v"] for r in sinks.latest(a, b).collect()} == {"1": "old", "2": "new", "3": "new"}
    path = str(tmp_path / "cache")
    sinks.cache_schema(spark.createDataFrame([("Tool", 1)], "source_tool string, n int"), path)
    sinks.cache_schema(spark.createDataFrame([("Other", 2)], "source_tool string, n int"), path)
    assert sinks.cached_schema(spark, path, "TOOL").first()["n"] == 1
    assert sinks.cached_schema(spark, path, "none") is None


def test_config(tmp_path):
    (tmp_path / "c.yaml").write_text("preprocessing: {max_chunk_chars: 5}\n")
    c = Config(tmp_path / "c.yaml")
    assert (c.get("preprocessing.max_chunk_chars"), c.get("preprocessing.min_chunk_chars"), c.get("a.b", 7)) == (5, 50, 7)


def test_stream(spark, tmp_path):
    docs = spark.createDataFrame([("a", "x\ny"), ("b", "z")], "doc_id string, text string")
    docs.write.parquet(str(tmp_path / "in"))
    ingest.chunk_stream(spark, str(tmp_path / "in"), docs.schema, str(tmp_path / "out"), str(tmp_path / "cp"), 100).awaitTermination()
    assert {(r["doc_id"], r["content_text"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {("a", "x\n\ny"), ("b", "z")}
