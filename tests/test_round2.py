"""Inputs the given tables do not have: missing scores and categories, half-parsable responses."""

from __future__ import annotations

import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from qaloom.functions.text import format_score
from qaloom.functions.vectors import matrix
from qaloom.operators.dense import range_index
from qaloom.operators import gates, pairing, responses, retrieval, split, stats
from qaloom.operators.generation import correct_text, generate_with_retry
from qaloom.plans import answering, jobs
from qaloom.schemas import ANSWER_MARKER, OPTION_ANSWER_MARKER, OPTION_MARKER, PAIR_MARKERS, RUBRIC_MARKERS
from qaloom.sources import writers
from qaloom.sources.readers import scan_passages

Q, A = PAIR_MARKERS
ONE, TWO, THREE = RUBRIC_MARKERS
O, OA = OPTION_MARKER, OPTION_ANSWER_MARKER

RESPONSES = [
    "",
    "nothing",
    f"1{O}A1\n2{O}A2\n3{O}{Q}why?{OA}because",
    f"1{O}A1\n2{O}A2\n3{O}why?{OA}because",
    f"1{O}foo{O}A2\n2{O}A1\n3{O}{Q}why?{OA}because",
    f"1{O}A9\n2{O}A1\n3{O}{Q}why?{OA}because",
    f"1{O}A1\n2{O}A1\n3{O}{Q}why?",
    f"{ONE}3{TWO}4{THREE}5",
    f"{ONE} 3\n{TWO} +4\n{THREE}5 ",
    f"{ONE}3{ONE}3{TWO}4{THREE}5",
    f"{ONE}3{TWO}4{THREE}12345678901",
    f"{ONE}3{TWO}4{THREE}5\u00a0",
    f"{ONE}3{TWO}4.5{THREE}5",
    f"{THREE}3{TWO}4{ONE}5",
    f"{Q}a{A}b",
    f"{A}b{Q}a",
    f"{Q}a",
    f"x{ANSWER_MARKER}y",
]


@pytest.mark.parametrize("name", ["RUBRIC", "PAIR", "LABELS", "ANSWER"])
def test_asked_again_exactly_when_it_does_not_parse(spark, name):
    parser = getattr(responses, name)
    rows = spark.createDataFrame([(r,) for r in RESPONSES], "response string")
    got = rows.select("response", parser.columns(F.col("response"))["ok"].alias("ok")).collect()
    assert {r.response: r.ok for r in got} == {r: parser.readable(r) for r in RESPONSES}
    assert len({r.ok for r in got}) == 2


def test_half_parsable_responses_are_retried(spark):
    def marks(texts, attempt):
        return [f"{ONE}3{TWO}4{THREE}12345678901" if attempt == 1 else f"{ONE}3{TWO}4{THREE}5" for _ in texts]

    asked = spark.createDataFrame([(1, "p")], "row_id long, prompt string")
    row = generate_with_retry(asked, ["row_id"], marks, responses.RUBRIC, 3).first()
    assert (row.attempt, row.average) == (2, 4.0)


def test_missing_scores_stay_missing(spark, tmp_path):
    rows = spark.createDataFrame([(1, 3.0), (2, None)], "row_id long, average_score double")
    assert [r.s for r in rows.select(format_score(F.col("average_score")).alias("s")).collect()] == ["3.00", None]
    assert {r.average_score: r.n for r in stats.score_histogram(rows).collect()} == {"3.00": 1, None: 1}
    writers.write_jsonl(rows, str(tmp_path / "out"))
    lines = [json.loads(x) for f in (tmp_path / "out").glob("part-*") for x in f.read_text().splitlines()]
    assert sorted((x["row_id"], x["average_score"]) for x in lines) == [(1, "3.00"), (2, None)]


def test_one_rule_for_missing_outputs(spark):
    rows = spark.createDataFrame([("abc",), (None,), ("123",), ("かな",)], "output string")
    for share in (0.0, 0.5):
        assert {r.output for r in gates.foreign_script_filter(rows, max_share=share).collect()} == {None, "123"}


def test_rows_without_category_are_paired_among_themselves(spark):
    rows = [(i, f"q{i}", f"a{i}", None if i % 2 else "c") for i in range(8)]
    qa = spark.createDataFrame(rows, "row_id long, input string, output string, category string")
    pairs = pairing.category_partner(qa, 1).collect()
    assert len(pairs) == 8 and all(p.partner_id % 2 == p.row_id % 2 for p in pairs)
    two = {r.category: (r.row_id_1, r.row_id_2) for r in pairing.category_sample_two(qa, 1).collect()}
    assert set(two) == {"c", None} and all(i % 2 for i in two[None])


def test_fold_key_keeps_its_type(spark):
    rows = spark.createDataFrame([(i, i % 3 if i % 4 else None) for i in range(40)], "row_id long, category int")
    folds = split.stratified_folds(rows, 1, 4)
    assert dict(folds.dtypes)["category"] == "int"
    assert {(r.row_id, r.category) for r in folds.collect()} == {(r.row_id, r.category) for r in rows.collect()}


@pytest.mark.parametrize("lists", [[[1.0, 2.0, 3.0], [1.0]], [[1.0], None]])
def test_ragged_vectors_are_refused(lists):
    with pytest.raises(ValueError):
        matrix(pa.array(lists, pa.list_(pa.float32())))


def test_repeated_ids_keep_their_lines(spark):
    asked = spark.createDataFrame([("x", "one"), ("x", "two"), (None, "three")], "id string, question string")
    answer = lambda texts, attempt: [f"{t}{ANSWER_MARKER}{t[-3:]}" for t in texts]
    assert answering.answer_questions(asked, answer).count() == 3
    passages = spark.createDataFrame([(1, "p", [1.0, 0.0])], "doc_id long, page_content string, embedding array<float>")
    embed = lambda texts: [[1.0, float(len(t))] for t in texts]
    chunks = lambda texts, attempt: [[t] for t in texts]
    made = answering.retrieve_and_answer(asked, passages, embed, chunks).collect()
    assert sorted((r.id or "", r.input) for r in made) == [("", "three"), ("x", "one"), ("x", "two")]


def test_corrections_are_asked_for_once(spark):
    import random

    rows = spark.createDataFrame([(i, "in", "out") for i in range(20)], "row_id long, input string, output string")
    fixed = correct_text(rows, lambda texts: [f"{t} {random.random()}" for t in texts])
    assert sorted(fixed.collect()) == sorted(fixed.collect())


def test_candidate_set_writes_the_rows_once(spark):
    wide = spark.createDataFrame(
        [(1, "q1", None, *["x" * 150] * 5, "c")],
        "row_id long, q1 string, q2 string, a1 string, a2 string, a3 string, a4 string, a5 string, category string",
    )
    score = lambda texts, attempt: [f"{ONE}3{TWO}4{THREE}5" for _ in texts]
    kept, _ = jobs.candidate_set(wide, score)
    assert kept.count() == 5


def test_rows_into_the_last_top_k_do_not_grow_with_splits(spark):
    queries = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(20)], "id long, embedding array<float>")
    passages = spark.range(4000).selectExpr("id AS doc_id", "array(float(id), float(id % 7)) AS embedding").repartition(200)
    found = retrieval.knn_join(queries, passages, 3)
    # Tasks follow the bytes to read; beyond ``GROUPS`` of them a first merge comes between.
    tasks = retrieval._search_tasks(passages, 20 * 3)
    assert tasks <= retrieval.GROUPS
    assert f"Coalesce {tasks}" in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 60


def test_pruned_search_by_default_equals_the_plain_one(spark):
    queries = spark.createDataFrame([(i, [float(i * 13), 1.0]) for i in range(20)], "id long, embedding array<float>")
    passages = spark.range(900).selectExpr("id AS doc_id", "array(float(id % 300), float(id % 7)) AS embedding")
    plain = sorted(map(tuple, retrieval.knn_join(queries, passages, 3).collect()))
    assert sorted(map(tuple, retrieval.knn_join_pruned(queries, passages, 3, block_queries=4).collect())) == plain


def test_sparse_ids_get_dense_positions(spark):
    rows = spark.range(5000).selectExpr("xxhash64(id) AS row_id", "id AS other")
    got = sorted((r.row_id, r.position) for r in range_index(rows, "row_id").collect())
    assert [p for _, p in got] == list(range(5000))


def test_part_numbers_count_as_numbers(spark, tmp_path):
    for part in (10, 2, 100000, 99999):
        (tmp_path / f"part-{part}.csv").write_text(f"0\np{part}\n")
    rows = scan_passages(spark, str(tmp_path), header_prefix=False, multi_line=False).orderBy("doc_id").collect()
    assert [(r.doc_id, r.page_content) for r in rows] == [(0, "p2"), (1, "p10"), (2, "p99999"), (3, "p100000")]
