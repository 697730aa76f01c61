"""The stages of the pipeline, each judged on its own input, and the whole of it."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402
from __spark_entry__ import queries  # noqa: E402
from qaloom.llm import simhash, tiling, toxicity  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Name -> (rows in, rows out) of every stage."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, SF)
        rows = made.collect()
        out[name] = docs.collect(), rows
        if name != corpus_pipeline.STAGES[-1][0]:
            assert made.columns == docs.columns
            docs = spark.createDataFrame(rows, docs.schema)
    return out


def test_stages(spark, stages):
    (a, b), (_, c), (_, d), (_, e), (_, f) = stages.values()
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    scored = {r.doc_id: r.predicted for r in toxicity.predictions(spark.createDataFrame(a), labels).collect()}
    assert {r.doc_id for r in b} == {i for i, p in scored.items() if not p}
    assert [r.doc_id for r in sorted(c)] == [r.doc_id for r in sorted(b)]
    before = {r.doc_id: r.text.split("\n") for r in b}
    assert all(set(r.text.split("\n")) <= {*before[r.doc_id], ""} and r.n_chars == len(r.text) for r in c)
    kept = [x for r in c for x in r.text.split("\n") if x.strip()]
    assert len(kept) == len(set(kept)) and len(kept) > 0.5 * sum(len(x) for x in before.values())
    groups = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(c)).collect()}
    assert sorted(r.doc_id for r in d) == sorted(set(groups.values()))
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    leaks = {r.doc_id for r in tiling.report(spark.createDataFrame(d), benchmark).collect() if r.contaminated}
    assert {r.doc_id for r in e} == {r.doc_id for r in d} - leaks
    assert {r.doc_id: r.n_tokens for r in f}.keys() == {r.doc_id for r in e}
    assert all(len(r.ids) == r.n_tokens for r in f)


def test_run_gives_what_the_stages_give(spark, stages):
    *_, last = stages.values()
    assert sorted(map(tuple, queries()["pipeline"](spark, SF).collect()), key=repr) == sorted(map(tuple, last[1]), key=repr)


def test_odd_documents_pass(spark):
    rows = [(None, None, "en", "s", 0), (1, "", "en", "s", 0), (2, None, None, None, None), (3, "one line\n\none line", "en", "s", 18), (3, "one line\n\none line", "en", "s", 18)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, removed string")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), docs.schema)
    assert sorted((r.doc_id, r.text) for r in docs.collect() if r.doc_id == 3) == [(3, "one line\n")]
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0
