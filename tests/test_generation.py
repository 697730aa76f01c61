from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import functions as F

from qaloom.operators.generation import correct_text, embed_text, generate_with_retry
from qaloom.operators.responses import FIRST_CHUNK, PAIR
from qaloom.plans import augment, jobs

# The stand-ins below run in Python workers that cannot import this file.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def prompts(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "row_id long, prompt string")


def needs(texts, attempt):
    """Parses from the attempt on that the prompt names; raises where the prompt says so."""
    if any(t == "raise" for t in texts):
        raise RuntimeError("no answer")
    return [
        f"Q: {t}\nA: at {attempt}" if t != "never" and attempt >= int(t) else "nothing" for t in texts
    ]


def test_attempts(spark):
    asked = prompts(spark, ["1", "3", "5", "never", "raise", "1"])
    made = generate_with_retry(asked, ["row_id"], needs, PAIR, 5)
    got = {r["row_id"]: (r["input"], r["output"], r["attempt"]) for r in made.collect()}
    assert got == {0: ("1", "at 1", 1), 1: ("3", "at 3", 3), 2: ("5", "at 5", 5), 5: ("1", "at 1", 1)}
    kept = generate_with_retry(asked, ["row_id"], needs, PAIR, 2, on_fail="keep")
    assert {r["row_id"]: r["ok"] for r in kept.collect()} == {
        0: True, 1: False, 2: False, 3: False, 4: False, 5: True,
    }


def test_model_is_asked_once(spark):
    """The responses are written: a second action gives the same random text."""

    def random_text(texts, attempt):
        import random

        return [f"Q: {random.random()}\nA: x" for _ in texts]

    made = generate_with_retry(prompts(spark, ["a"] * 50), ["row_id"], random_text, PAIR, 3)
    assert sorted(made.collect()) == sorted(made.collect())


def test_chunks(spark):
    made = generate_with_retry(
        prompts(spark, ["a", "b"]),
        ["row_id"],
        lambda texts, attempt: [["x", "y"] if t == "a" else [] for t in texts],
        FIRST_CHUNK,
        1,
        on_fail="keep",
        result_type="array<string>",
    )
    assert {r["row_id"]: r["answer"] for r in made.collect()} == {0: "x", 1: None}


def test_wrong_number_of_results_fails_row_by_row(spark):
    def loses_one(texts, attempt):
        return [f"Q: {t}\nA: x" for t in texts if t != "b"]

    made = generate_with_retry(prompts(spark, ["a", "b", "c"]), ["row_id"], loses_one, PAIR, 1)
    assert {r["row_id"] for r in made.collect()} == {0, 2}


def test_embedding_failures(spark):
    def embed(texts):
        if "bad" in texts:
            raise ValueError("bad")
        return [[float(len(t)), 1.0] for t in texts]

    df = spark.createDataFrame([("ab",), ("bad",), (None,)], "t string")
    assert [r["embedding"] for r in embed_text(df, "t", embed).collect()] == [[2.0, 1.0], None, None]


def test_correction_failures(spark):
    def correct(texts):
        return [None if t == "fails" else t.strip() for t in texts]

    df = spark.createDataFrame(
        [(0, " a", "b"), (1, "fails", "b"), (2, "a", None), (3, "a", "b")],
        "row_id long, input string, output string",
    )
    rows = {r["row_id"]: r["is_corrected"] for r in correct_text(df, correct).collect()}
    assert rows == {0: True, 3: False}


def marks(value):
    from qaloom.schemas import RUBRIC_MARKERS

    return "".join(f"{m}{value}" for m in RUBRIC_MARKERS)


def test_default_score_passes_the_gate(spark, qa):
    scored = jobs.score_rows(qa, lambda texts, attempt: ["no marks"] * len(texts))
    assert scored.where("average_score = 3.0 and score_defaulted").count() == qa.count()
    curated = jobs.curate(qa, lambda texts, attempt: ["no marks"] * len(texts))
    assert 0 < curated.count() < qa.count()


def test_scores_can_be_replaced(spark, qa):
    first = jobs.score_rows(qa, lambda texts, attempt: [marks(1)] * len(texts))
    again = jobs.score_rows(first, lambda texts, attempt: [marks(4)] * len(texts))
    assert again.columns == first.columns
    assert {r["average_score"] for r in again.collect()} == {4.0}


def test_answers_keep_their_position(spark):
    from qaloom.plans.answering import answer_questions, build_submission

    asked = spark.createDataFrame(
        [(i, f"T{i}", f"question {i}") for i in range(4)], "row_id long, id string, question string"
    )

    def answer(texts, attempt):
        return ["no marker" if "question 2" in t else t + "x" * len(t) for t in texts]

    answers = answer_questions(asked, answer)
    assert {r["row_id"]: r["output"] is None for r in answers.collect()} == {
        0: False, 1: False, 2: True, 3: False,
    }
    template = asked.selectExpr("row_id", "id", "-1.0D AS c0")
    for by in ("row_id", "id"):
        wide = build_submission(answers, template, lambda texts: [[float(len(t))] for t in texts], by)
        got = {r["id"]: r["c0"] for r in wide.collect()}
        assert got["T2"] == -1.0 and min(got["T0"], got["T1"], got["T3"]) > 0


def test_synthesized_rows_stay_in_their_category(spark, qa):
    made = jobs.synthesize_pairs(
        qa, lambda texts, attempt: [f"Q: new\nA: {len(t)}" for t in texts], 1, repeats=2
    )
    by_id = {r["row_id"]: r["category"] for r in qa.collect()}
    rows = made.collect()
    assert len(rows) == 240 and all(by_id[r["row_id"]] == r["category"] for r in rows)


def test_augment_draws_from_the_growing_set(spark):
    """Two rows in the pool: later rounds must come across generated rows."""
    base = spark.createDataFrame(
        [(i, f"base {i}", "x" * 120, "a") for i in range(3)]
        + [(10 + i, f"other {i}", "x", "b") for i in range(2)],
        "row_id long, input string, output string, category string",
    )

    def write(texts, attempt):
        return [f"Q: made from [{t.count('made')}]\nA: {'y' * 150}" for t in texts]

    made = augment.augment_rounds(
        base, write, lambda texts, attempt: [marks(4)] * len(texts), 3, rounds=6, categories=["a", "b"]
    )
    rows = made.orderBy("round").collect()
    # Category b has one row in its pool, so it never yields a pair.
    assert [(r["round"], r["category"], r["idx"]) for r in rows] == [(n, "a", 2 + n) for n in range(6)]
    assert any("[0]" not in r["input"] for r in rows)
    assert {r["average_score"] for r in rows} == {4.0}


def test_augment_gates(spark, qa):
    write = lambda texts, attempt: [f"Q: q\nA: {'y' * 150}" for _ in texts]
    short = lambda texts, attempt: ["Q: q\nA: short" for _ in texts]
    low = lambda texts, attempt: [marks(2)] * len(texts)
    names = ["a", "b"]
    assert augment.augment_rounds(qa, write, low, 1, rounds=1, categories=names).count() == 0
    assert augment.augment_rounds(qa, short, low, 1, rounds=1, categories=names).count() == 0
    assert augment.augment_rounds(qa, write, low, 1, rounds=0, categories=names).count() == 0


def test_training_set_sides(spark, qa, tmp_path):
    path = str(tmp_path / "training")
    jobs.write_training_set(jobs.training_set(qa, 1, 10), path)
    held_out = spark.read.parquet(path).where(F.col("side") == "eval")
    assert held_out.count() in (12, 13)
    plan = held_out._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(side" in plan
