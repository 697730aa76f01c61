from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from qaloom.functions.hashing import hash_draw, stable_hash
from qaloom.functions.text import fill, format_score, marker_split, parse_int, text_length
from qaloom.operators.responses import (
    LABELS,
    PAIR,
    RUBRIC,
    extract_answer,
    first_chunk,
    parse_labels,
    parse_qa_pair,
    parse_rubric,
)
from qaloom.schemas import RUBRIC_MARKERS

M1, M2, M3 = RUBRIC_MARKERS


def one(spark, text, expression):
    df = spark.createDataFrame([(text,)], "t string")
    return df.select(expression(F.col("t")).alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("text", "number"),
    [(" 4\n", 4), ("+4", 4), ("-1", -1), ("4.5", None), ("4점", None), ("", None), (None, None)],
)
def test_parse_int(spark, text, number):
    assert one(spark, text, parse_int) == number


@pytest.mark.parametrize("text", ["a|b|c", "abc", "|", "", "a||b", "|a"])
@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_marker_split_is_python_split(spark, text, n):
    parts = text.split("|")
    expected = parts[n] if n < len(parts) else None
    assert one(spark, text, lambda t: marker_split(t, "|", n)) == expected


def test_marker_is_literal(spark):
    assert one(spark, "a.*b.*c", lambda t: marker_split(t, ".*", 1)) == "b"


def test_length_counts_code_points(spark):
    assert one(spark, "가é😀", text_length) == 4


def test_score_text(spark):
    texts = [one(spark, str(total), lambda t: format_score(t.cast("int") / 3)) for total in (10, 11, 13)]
    assert texts == ["3.33", "3.67", "4.33"]


def test_fill_prints_missing_as_empty(spark):
    assert one(spark, None, lambda t: fill("[{x}] {{kept}}", x=t)) == "[] {kept}"


def rubric(a="4", b="5", c="3", tail=""):
    return f"{M1}{a}{M2}{b}{M3}{c}{tail}"


@pytest.mark.parametrize(
    ("text", "average"),
    [
        (rubric(), 4.0),
        ("intro " + rubric(" 4\n", "+5", "0"), 3.0),
        (rubric("9", "9", "9"), 9.0),
        (rubric(c="4.5"), None),
        (rubric(c="4점"), None),
        (rubric(a=""), None),
        (rubric(tail="\nwell written"), None),
        (f"{M1}4{M2}5", None),
        (f"x{M2}5{M3}3\n{M1}4", None),
        ("", None),
        (None, None),
    ],
)
def test_parse_rubric(spark, text, average):
    got = one(spark, text, parse_rubric)
    assert text is None or RUBRIC.readable(text) == got["ok"]
    assert got["ok"] == (average is not None)
    assert got["average"] == average


def test_rubric_clamp(spark):
    got = one(spark, rubric("9", "-2", "3"), lambda t: parse_rubric(t, clamp=True))
    assert (got["accuracy"], got["completeness"], got["naturalness"]) == (5, 0, 3)


@pytest.mark.parametrize(
    ("text", "pair"),
    [
        ("Q: why\nA: because", ("why", "because")),
        ("so Q: why\nA: because", ("why", "because")),
        ("Q: one Q: two\nA: x", ("one Q: two"[:4], "x")),
        ("Q: why\nA: because\nA: also", ("why", "because")),
        ("why\nA: because", None),
        ("Q: why A: because", None),
        (None, None),
    ],
)
def test_parse_qa_pair(spark, text, pair):
    got = one(spark, text, parse_qa_pair)
    assert text is None or PAIR.readable(text) == got["ok"]
    if pair is None:
        assert not got["ok"] and got["input"] is None
    else:
        assert got["ok"] and (got["input"], got["output"]) == pair


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("1. A1\n2. A3\n3. Q: q A: a", ("A1", "A3", "q", "a")),
        ("1. A1\n2. A3\n3. Q: q A: a A: more", ("A1", "A3", "q", "a")),
        ("1. A9\n2. A3\n3. Q: q A: a", None),
        ("1. A1 \n2. A3\n3. Q: q A: a", None),
        ("1. A1\n2. A3", None),
        ("1. A1", None),
        ("1. A1\n2. A3\n\n3. Q: q A: a", None),
        ("A1\nA3\n3. Q: q A: a", None),
        (None, None),
    ],
)
def test_parse_labels(spark, text, expected):
    got = one(spark, text, parse_labels)
    assert text is None or LABELS.readable(text) == got["ok"]
    if expected is None:
        assert got["ok"] is False
    else:
        assert got["ok"] and (got["k1"], got["k2"], got["q3"], got["a3"]) == expected


def test_extract_answer(spark):
    ask = lambda t: extract_answer(t, "### A: ")
    assert one(spark, "p ### A: x ### A: y", ask)["answer"] == "x "
    assert one(spark, "p", ask)["ok"] is False


def test_first_chunk(spark):
    df = spark.createDataFrame([(["a", "b"],), ([],), (None,)], "c array<string>")
    assert [r[0] for r in df.select(first_chunk(F.col("c"))).collect()] == ["a", None, None]


def test_draws(spark):
    df = spark.range(5000).select(stable_hash(F.col("id"), "s").alias("h"))
    draws = [r[0] for r in df.select(hash_draw(F.col("h"), 7)).collect()]
    assert set(draws) == set(range(7))
    assert max(draws.count(v) for v in range(7)) < 5000 / 7 * 1.15
    assert df.select(hash_draw(F.col("h"), 0)).first()[0] is None
