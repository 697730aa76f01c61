from __future__ import annotations

import json

from pyspark.sql import functions as F

from qaloom.operators import prompts, reshape

WIDE = "row_id long, q1 string, q2 string, a1 string, a2 string, a3 string, a4 string, a5 string, category string"


def wide(spark):
    return spark.createDataFrame(
        [
            (0, "q1", "q2", "a1", "a2", "a3", "a4", "a5", "c"),
            (1, None, None, "b1", None, "b3", "b4", "b5", "d"),
        ],
        WIDE,
    )


def test_unpivot(spark):
    rows = reshape.unpivot_answers(wide(spark)).orderBy("row_id", "a_no", "q_no").collect()
    assert [(r["a_no"], r["q_no"], r["input"], r["output"]) for r in rows[:3]] == [
        (1, 1, "q1", "a1"), (1, 2, "q2", "a1"), (2, 1, "q1", "a2"),
    ]
    # Question 1 stays even when it is missing; question 2 does not.
    second = [(r["a_no"], r["input"], r["output"]) for r in rows if r["row_id"] == 1]
    assert second == [(1, None, "b1"), (2, None, None), (3, None, "b3"), (4, None, "b4"), (5, None, "b5")]


def test_expand_labels(spark):
    labels = spark.createDataFrame(
        [(0, "A5", "A1", "q3", "a3", True), (1, "A2", "A1", "x", "y", True)],
        "row_id long, k1 string, k2 string, q3 string, a3 string, ok boolean",
    )
    rows = reshape.expand_labels(wide(spark), labels).orderBy("row_id", "label_no").collect()
    assert [(r["input"], r["output"]) for r in rows[:3]] == [("q1", "a5"), ("q2", "a1"), ("q3", "a3")]
    # A chosen answer that is missing is kept as missing.
    assert (rows[3]["input"], rows[3]["output"], rows[3]["category"]) == (None, None, "d")
    none = labels.withColumn("ok", F.lit(False))
    assert reshape.expand_labels(wide(spark), none).count() == 0


def test_pick_option(spark):
    keys = spark.createDataFrame([("A1",), ("A9",), ("A1 ",), (None,)], "k string")
    texts = [F.lit(f"t{i}") for i in range(1, 6)]
    got = [r[0] for r in keys.select(reshape.pick_option(F.col("k"), texts)).collect()]
    assert got == ["t1", None, None, None]


def test_correction_audit(spark):
    df = spark.createDataFrame(
        [
            (0, "a", "b", "a", "b"), (1, "a", "b", "A", "b"), (2, "a", "b", "a", "B"),
            (3, "a", "b", None, "b"), (4, "a", "b", "a", None),
        ],
        "row_id long, input string, output string, corrected_input string, corrected_output string",
    )
    rows = reshape.correction_audit(df).orderBy("row_id").collect()
    assert [tuple(r) for r in rows] == [
        (0, "a", "b", False, "", ""), (1, "A", "b", True, "a", "b"), (2, "a", "B", True, "a", "b"),
    ]


def test_record_keeps_missing_keys(spark):
    record = reshape.row_to_record(wide(spark)).collect()[1]["record"]
    assert json.loads(record)["q1"] is None


def test_vector_columns(spark):
    df = spark.createDataFrame([(1, [0.5, 2.0])], "id long, embedding array<float>")
    assert reshape.vector_to_columns(df, 3).first().asDict() == {"id": 1, "c0": 0.5, "c1": 2.0, "c2": None}


def test_union_keeps_duplicates(spark, qa):
    more = qa.withColumn("average_score", F.lit(3.0))
    both = reshape.union_generated(qa, qa, more)
    assert both.count() == 3 * qa.count()
    assert both.where("average_score is null").count() == 2 * qa.count()


def test_missing_values_in_prompts(spark):
    text = prompts.build_option_prompt(wide(spark)).orderBy("row_id").collect()[1]["prompt"]
    assert "(Q2): \n" in text and "A2. \n" in text and "A5. b5" in text
    messages = prompts.build_option_messages(wide(spark)).orderBy("row_id").first()["messages"]
    assert [m["role"] for m in messages] == ["system", "user"]


def test_context_prompt_without_hits(spark):
    questions = spark.createDataFrame([("T1", "why?")], "id string, question string")
    contexts = spark.createDataFrame([], "id string, context string")
    assert "why?" in prompts.build_context_prompt(questions, contexts).first()["prompt"]


def test_sort_and_preview(spark, qa):
    assert [r["row_id"] for r in reshape.preview(qa, 3).collect()] == [0, 1, 2]
    first = reshape.sort_by_category(qa).first()
    assert (first["category"], first["row_id"]) == ("a", 1)
