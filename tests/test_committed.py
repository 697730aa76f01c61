"""Model calls that are committed as they come in, and rounds that go on where they stopped."""

from __future__ import annotations

import sys
from collections import Counter
from pathlib import Path

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame as ClassicFrame

from qaloom.functions.batch import CALL_SIZE
from qaloom.operators.dense import RankDirectory, hash_index
from qaloom.operators.generation import NoUsableResponse, generate_with_retry
from qaloom.operators.responses import PAIR
from qaloom.plans import augment, jobs
from qaloom.schemas import RUBRIC_MARKERS

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MARKS = "".join(f"{m}4" for m in RUBRIC_MARKERS)


def prompts(spark, n):
    return spark.createDataFrame([(i, f"p{i}") for i in range(n)], "row_id long, prompt string")


def counting(folder, dies_at=None):
    """Notes every prompt in a file of its own name; kills its worker at a prompt."""

    def answer(texts, attempt):
        import os

        for t in texts:
            if t == dies_at:
                os._exit(1)
            with open(f"{folder}/{t}", "a") as f:
                f.write("x")
        return [f"Q: {t}\nA: {t}" for t in texts]

    return answer


def calls(folder):
    return {p.name: len(p.read_text()) for p in Path(folder).iterdir()}


def test_a_killed_job_asks_only_for_what_is_not_committed(spark, tmp_path):
    seen, store = tmp_path / "seen", str(tmp_path / "store")
    seen.mkdir()
    asked = prompts(spark, 60).coalesce(1)
    options = {"store": store, "commit_rows": 5, "commit_files": 1, "placed": True}
    with pytest.raises(Exception):
        generate_with_retry(asked, ["row_id"], counting(seen, "p37"), PAIR, 3, **options)
    first = calls(seen)
    assert 0 < len(first) < 60 and "p37" not in first
    made = generate_with_retry(asked, ["row_id"], counting(seen), PAIR, 3, **options)
    assert sorted(r.row_id for r in made.collect()) == list(range(60))
    again = {name for name, n in calls(seen).items() if n > 1}
    # Only prompts of the one batch that was under way are asked twice.
    assert again <= set(first) and len(again) < 5
    before = calls(seen)
    third = generate_with_retry(asked, ["row_id"], counting(seen), PAIR, 3, **options)
    assert third.count() == 60 and calls(seen) == before


def test_nothing_to_ask(spark, tmp_path):
    made = generate_with_retry(prompts(spark, 0), ["row_id"], counting(tmp_path), PAIR, 3, store=str(tmp_path / "store"))
    assert made.count() == 0 and "input" in made.columns


def test_calls_are_of_bounded_size(spark, tmp_path):
    def sizes(texts, attempt):
        return [f"Q: {len(texts)}\nA: x" for _ in texts]

    rows = prompts(spark, 300).coalesce(1)
    usual = generate_with_retry(rows, ["row_id"], sizes, PAIR, 1, placed=True).collect()
    assert max(int(r.input) for r in usual) == CALL_SIZE
    single = generate_with_retry(rows, ["row_id"], sizes, PAIR, 1, placed=True, call_size=1).collect()
    assert {r.input for r in single} == {"1"}


def test_the_cause_of_a_failure_is_kept(spark, qa):
    def down(texts, attempt):
        raise ConnectionError("service is down")

    kept = generate_with_retry(prompts(spark, 3), ["row_id"], down, PAIR, 2, on_fail="keep").collect()
    assert {r.error for r in kept} == {"ConnectionError: service is down"}
    with pytest.raises(NoUsableResponse, match="3 prompts.*service is down"):
        generate_with_retry(prompts(spark, 3), ["row_id"], down, PAIR, 2, on_fail="raise")
    with pytest.raises(NoUsableResponse, match="service is down"):
        jobs.score_rows(qa, down, on_fail="raise")
    scored = jobs.score_rows(qa, down, error="why")
    assert {(r.average_score, r.score_defaulted, r.why) for r in scored.collect()} == {(3.0, True, "ConnectionError: service is down")}
    fine = jobs.score_rows(qa, lambda texts, attempt: [MARKS] * len(texts), on_fail="raise", error="why")
    assert {r.why for r in fine.collect()} == {None}
    with pytest.raises(ValueError):
        generate_with_retry(prompts(spark, 1), ["row_id"], down, PAIR, 1, on_fail="ignore")


def test_options_are_labelled_without_a_join(spark):
    from qaloom.schemas import OPTION_ANSWER_MARKER as OA, OPTION_MARKER as O, PAIR_MARKERS

    wide = spark.createDataFrame(
        [(i, "q1", "q2", "x1", "x2", "x3", "x4", "x5", "c") for i in range(3)],
        "row_id long, q1 string, q2 string, a1 string, a2 string, a3 string, a4 string, a5 string, category string",
    )
    made = jobs.label_options(wide, lambda texts, attempt: [f"1{O}A3\n2{O}A5\n3{O}{PAIR_MARKERS[0]}new{OA}a new one"] * len(texts))
    assert Counter((r.label_no, r.input, r.output) for r in made.collect()) == {
        (1, "q1", "x3"): 3, (2, "q2", "x5"): 3, (3, "new", "a new one"): 3,
    }
    assert "Join" not in made._jdf.queryExecution().executedPlan().toString()


def base_rows(spark):
    return spark.createDataFrame(
        [(i, f"base {i}", "x" * 120, "a" if i % 3 else "b") for i in range(30)],
        "row_id long, input string, output string, category string",
    )


def write(texts, attempt):
    import hashlib

    return [f"Q: made {hashlib.md5(t.encode()).hexdigest()}\nA: {'y' * 150}" for t in texts]


def score(texts, attempt):
    import hashlib

    return [MARKS if int(hashlib.md5(t.encode()).hexdigest(), 16) % 3 else "".join(f"{m}1" for m in RUBRIC_MARKERS) for t in texts]


def test_rounds_bring_no_text_to_the_driver(spark, monkeypatch):
    seen = []
    for name in ("collect", "toPandas", "toArrow", "take", "first", "head", "toLocalIterator"):
        original = getattr(ClassicFrame, name)
        monkeypatch.setattr(ClassicFrame, name, lambda self, *a, _f=original, **k: (seen.append(set(self.columns)), _f(self, *a, **k))[1])
    made = augment.augment_rounds(base_rows(spark), write, score, 1, rounds=7, categories=["a", "b"], window=3)
    assert seen and not any(c & {"input", "output", "q1", "a1", "prompt", "response"} for c in seen)
    monkeypatch.undo()
    assert made.count() > 0


def test_windows_do_not_change_the_rounds(spark):
    got = [
        sorted(map(tuple, augment.augment_rounds(base_rows(spark), write, score, 1, rounds=9, categories=["a", "b"], window=w).collect()))
        for w in (1, 4, 50)
    ]
    assert got[0] == got[1] == got[2] and len(got[0]) > 6


def test_rounds_go_on_where_they_stopped(spark, tmp_path):
    seen, folder = tmp_path / "seen", str(tmp_path / "rounds")
    seen.mkdir()

    def noted(texts, attempt):
        import uuid

        (seen / uuid.uuid4().hex).write_text("x" * len(texts))
        return write(texts, attempt)

    usual = sorted(map(tuple, augment.augment_rounds(base_rows(spark), write, score, 1, rounds=8, categories=["a", "b"]).collect()))
    augment.augment_rounds(base_rows(spark), noted, score, 1, rounds=5, categories=["a", "b"], window=3, folder=folder)
    half = sum(calls(seen).values())
    made = augment.augment_rounds(base_rows(spark), noted, score, 1, rounds=8, categories=["a", "b"], window=3, folder=folder)
    assert sorted(map(tuple, made.collect())) == usual
    assert (half, sum(calls(seen).values())) == (10, 16)


def test_directory_agrees_with_the_full_index(spark, qa):
    for skip_first in (True, False):
        full = hash_index(qa, "category", "row_id", 3, skip_first).where("idx is not null").collect()
        directory = RankDirectory(qa, "category", "row_id", 3, skip_first)
        sizes = {r.category: r.pool_n for r in directory.sizes().collect()}
        want = {(r.category, r.idx): r.row_id for r in full}
        assert {c: n for c, n in sizes.items() if n} == dict(Counter(r.category for r in full))
        asked = spark.createDataFrame([(c, i, "x") for c, i in want] + [("a", 10_000, "x"), ("zz", 0, "x")], "category string, idx long, note string")
        got = directory.locate(asked)
        assert got.columns == ["category", "idx", "note", "row_id"]
        assert {(r.category, r.idx): r.row_id for r in got.collect()} == want


def test_directory_of_missing_keys_and_of_nothing(spark):
    rows = spark.createDataFrame([(1, None), (2, None), (3, "a")], "row_id long, category string")
    directory = RankDirectory(rows, "category", "row_id", 0)
    assert {r.category: r.pool_n for r in directory.sizes().collect()} == {None: 2, "a": 1}
    asked = rows.select("category", F.lit(0).cast("long").alias("idx")).distinct()
    assert {r.category for r in directory.locate(asked).collect()} == {None, "a"}
    empty = RankDirectory(rows.limit(0), "category", "row_id", 0, skip_first=True)
    assert empty.sizes().count() == 0 and empty.locate(asked).count() == 0
