"""The pipeline's stages against brute force, and the guard of the entry point."""

import random
import re
import subprocess
import sys
from collections import Counter

import corpus_pipeline
from test_llm import SCHEMA, classes, order, removed_words

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def test_run(spark, tmp_path):
    rng = random.Random(11)
    vocabulary = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(2000)]
    passage = rng.choices(vocabulary, k=30)
    leak = rng.choices(vocabulary, k=12)
    rows = []
    for i in range(40):
        w = rng.choices(vocabulary, k=80)
        if i % 5 == 0:
            w[40:40] = passage
        if i == 7:
            w[10:10] = leak
        rows.append((i, " ".join(w), "en", rng.choice(["a", "b", "c"]), 0))
    rows += [(50, rows[3][1], "en", "a", 0), (51, rows[3][1] + " more", "en", "a", 0), (52, "few words", "en", "b", 0), (53, None, "en", "b", 0), (54, "again and again " * 30, "en", "b", 0), (3, rows[3][1], "en", "a", 0)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, " ".join(leak))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # rules, one of each class (repeated rows once), repeated passages, leaks
    left = [r for r in {r[:2]: r for r in rows}.values() if r[0] not in (52, 53, 54)]
    first = {i: c for i, c, _ in classes(left)}
    left = [r for r in left if first[order(r[0])] == r[0]]
    gone = {k[0]: k[1] - k[2] for k in removed_words(left)}
    left = [r for r in left if r[0] != 7]
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((r[0], gone[r[0]]) for r in left)
    assert all(r["taken"] == r["copies"] * r["size"] for r in got)


def test_stages_keep_columns(spark, tmp_path):
    docs = spark.createDataFrame([], SCHEMA)
    spark.createDataFrame([(0, "x y")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == 0


def test_entry_without_this_subpackage(tmp_path):
    """The entry point imports and has the other queries where these folders are gone."""
    import pathlib
    import shutil

    top = pathlib.Path(corpus_pipeline.__file__).parent
    shutil.copytree(top / "clausewright", tmp_path / "clausewright", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(top / "__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), any(k.startswith('op') for k in e.queries()))"], cwd=tmp_path, capture_output=True, text=True, check=True).stdout.split()
    assert int(said[0]) > 60 and said[1] == "False"
