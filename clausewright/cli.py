"""Command line: preprocess, discover-schema and atomize a document or a folder of them."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import config
from .errors import ClausewrightError
from .operators import discovery, gate
from .plans import pipeline
from .sources import docx, extractor, sinks


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="clausewright")
    p.add_argument("command", choices=["preprocess", "discover-schema", "atomize"])
    p.add_argument("--input", required=True)
    p.add_argument("--output", required=True, help="folder")
    p.add_argument("--config")
    p.add_argument("--second-pass", action="store_true", help="read documents whose report asks for it again")
    for stage in ("extractor", "component-extractor", "schema-extractor"):
        p.add_argument(f"--{stage}", metavar="MODULE:FUNCTION", help="a function from prompt to response")
    p.add_argument("--schema-cache", help="folder of earlier responses about schemas")
    p.add_argument("--prompts", help="folder of instructions, <node>/<version>.yaml")
    args = p.parse_args(argv)
    cfg = config.Config(args.config)
    spark = SparkSession.builder.getOrCreate()
    sizes = cfg.get("preprocessing.max_chunk_chars"), cfg.get("preprocessing.min_chunk_chars")
    try:
        patience = {k: (cfg.get(f"{k}.{n}"), cfg.get(f"{k}.retry_backoff_base"), cfg.get("llm.max_tokens")) for k, n in (("schema_discovery", "max_retries"), ("atomizer.batch_processing", "max_retries_per_batch"))}
        per_batch, schemas = patience["atomizer.batch_processing"], extractor.named(args.schema_extractor, *patience["schema_discovery"])
        chunks, stats = docx.parse_and_chunk(spark, args.input, None, *sizes)
        if args.command == "preprocess":
            chunks.write.mode("overwrite").json(f"{args.output}/{sinks.run_name('chunks', args.input)}")
            docx.with_file(stats, chunks).write.mode("overwrite").json(f"{args.output}/{sinks.run_name('stats', args.input)}")
        elif args.command == "discover-schema":
            flat = pipeline.flat_chunks(chunks)
            schema = pipeline.read_schemas(flat, schemas, args.schema_cache, cfg, args.prompts) if schemas else discovery.discovered_schema(flat)
            decided = gate.decide(schema.withColumn("document_format", F.lit("docx")), cfg.gates())
            decided.join(stats, "doc_id").write.mode("overwrite").json(f"{args.output}/{sinks.run_name('schema', args.input)}")
        else:
            blocks = docx.read_blocks(spark, args.input)
            calls = {"extractor": extractor.named(args.extractor, *per_batch) or extractor.deterministic, "component_extractor": extractor.named(args.component_extractor, *per_batch), "config": cfg}
            calls |= {"schema_extractor": schemas, "schema_cache": args.schema_cache, "prompt_folder": args.prompts}
            run = pipeline.run(blocks, **calls)
            if not run.gate.where("decision <> 'reject'").limit(1).count():
                print("The gate rejects all documents", file=sys.stderr)
                return 1
            if args.second_pass:
                run = pipeline.second_pass(run, blocks, **calls)
            run.payload().select("value").write.mode("overwrite").text(f"{args.output}/{sinks.run_name('atomized', args.input)}")
            run.skipped.write.mode("overwrite").json(f"{args.output}/{sinks.run_name('skipped', args.input)}")
            sinks.write_requirements(run.requirements, f"{args.output}/{sinks.run_name('requirements', args.input)}")
            run.report.write.mode("overwrite").json(f"{args.output}/{sinks.run_name('report', args.input)}")
            run.insights.write.mode("overwrite").json(f"{args.output}/{sinks.run_name('insights', args.input)}")
    except (ClausewrightError, ValueError, FileNotFoundError) as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
