"""The pipeline's stages one after another, and that the library works without the text operators."""

import subprocess
import sys
from pathlib import Path

import by_force
import corpus_pipeline

from tastemill.session import stored

FOLDER = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[2]


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    counts = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, FOLDER))
        assert docs.columns == columns
        counts.append(docs.count())
    assert counts[0] >= counts[1] > counts[2] >= counts[3]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).collect()
    assert len(last) == counts[-1]
    ends = [0] + [r.start + r.n_tokens for r in sorted(last, key=lambda r: r.start)]
    assert [r.start for r in sorted(last, key=lambda r: r.start)] == ends[:-1]


def test_stages_take_odd_rows(spark, documents, nothing):
    for docs in (documents, nothing):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stored(stage(spark, docs, FOLDER))
        left = {(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()}
        assert not any(t is None or not any(map(str.isalpha, t)) for _, t in left)


def test_the_rest_works_without_this_subpackage():
    code = (
        "import sys; sys.modules['tastemill.llm'] = None; sys.modules['corpus_pipeline'] = None;"
        "import __spark_entry__ as e; assert e.llm is None; q = e.queries();"
        "assert not any(k.startswith('op') or k == 'pipeline' for k in q); print(len(q))"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_the_pipeline_by_force(spark):
    docs = [r.asDict() for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    items = [r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    found = sorted(map(tuple, corpus_pipeline.run(spark, FOLDER).collect()), key=lambda r: r[1])
    assert found == by_force.pipeline(docs, items)
