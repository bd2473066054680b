"""The pipeline on the smallest tables, stage by stage."""

import os
import subprocess
import sys

import corpus_pipeline
from pagelayout.llm import queries

SF = "/root/testdata/sf0.001"


def test_stages_and_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "near_duplicates", "decontamination", "mixing", "sharding"]
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == [*docs.columns, "shard", "slot"]
    rows = out.collect()
    assert 0 < len(rows) and {r["shard"] for r in rows} == set(range(16))
    ids = [r["doc_id"] for r in rows]
    assert max(ids.count(i) for i in set(ids)) <= 3
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), SF).columns == docs.columns
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), SF).count() == 0


def test_each_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 14))


def test_entry_works_without_the_package():
    root = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    code = "import sys; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert 'pipeline' not in e.queries() and len(e.queries()) > 100; print(len(e.oracle_sql()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
