"""Parsers from a response text to typed columns.

Each returns a struct with ``ok``: whether the response could be read at all. The
functions take and return columns, so parsing runs in generated JVM code. A ``Parser``
adds a cheap test of one response for use inside a task: it only decides whether to ask
again, never what a response says.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from qaloom.functions.text import contains_text, marker_split, parse_int
from qaloom.schemas import (
    ANSWER_MARKER,
    OPTION_ANSWER_MARKER,
    OPTION_KEYS,
    OPTION_MARKER,
    PAIR_MARKERS,
    RUBRIC_MARKERS,
)


def parse_labels(response: Column) -> Column:
    """Three-line response: two option keys, then a new question and its answer."""
    lines = [marker_split(response, "\n", i) for i in range(3)]
    k1 = marker_split(lines[0], OPTION_MARKER, 1)
    k2 = marker_split(lines[1], OPTION_MARKER, 1)
    q3 = marker_split(
        marker_split(response, PAIR_MARKERS[0], 1), OPTION_ANSWER_MARKER, 0
    )
    a3 = marker_split(lines[2], OPTION_ANSWER_MARKER, 1)
    ok = (
        k1.isin(OPTION_KEYS) & k2.isin(OPTION_KEYS) & q3.isNotNull() & a3.isNotNull()
    )
    return F.struct(
        k1.alias("k1"),
        k2.alias("k2"),
        q3.alias("q3"),
        a3.alias("a3"),
        F.coalesce(ok, F.lit(False)).alias("ok"),
    )


def parse_qa_pair(response: Column) -> Column:
    """A question and an answer behind their markers."""
    question_marker, answer_marker = PAIR_MARKERS
    # Two cheap scans decide; the whole text is split only where both markers are there.
    ok = contains_text(response, question_marker) & contains_text(response, answer_marker)
    question = marker_split(
        F.split_part(response, F.lit(question_marker), F.lit(2)), answer_marker, 0
    )
    answer = F.split_part(response, F.lit(answer_marker), F.lit(2))
    return F.struct(
        F.when(ok, question).alias("input"),
        F.when(ok, answer).alias("output"),
        F.coalesce(ok, F.lit(False)).alias("ok"),
    )


def parse_rubric(
    response: Column, markers: list[str] | None = None, clamp: bool = False
) -> Column:
    """Three whole marks behind three markers, and their mean."""
    first, second, third = markers or RUBRIC_MARKERS
    texts = [
        marker_split(marker_split(response, first, 1), second, 0),
        marker_split(marker_split(response, second, 1), third, 0),
        marker_split(response, third, 1),
    ]
    marks = [parse_int(text) for text in texts]
    if clamp:
        marks = [F.when(m.isNotNull(), F.greatest(F.lit(0), F.least(F.lit(5), m))) for m in marks]
    accuracy, completeness, naturalness = marks
    total = sum((m.cast("bigint") for m in marks[1:]), marks[0].cast("bigint"))
    ok = accuracy.isNotNull() & completeness.isNotNull() & naturalness.isNotNull()
    return F.struct(
        accuracy.alias("accuracy"),
        completeness.alias("completeness"),
        naturalness.alias("naturalness"),
        (total / F.lit(3)).alias("average"),
        ok.alias("ok"),
    )


def extract_answer(text: Column, marker: str = ANSWER_MARKER) -> Column:
    """Text between the first and the second answer marker."""
    answer = marker_split(text, marker, 1)
    return F.struct(answer.alias("answer"), answer.isNotNull().alias("ok"))


def first_chunk(chunks: Column) -> Column:
    """First chunk of a response that came in chunks; NULL when there is none."""
    return F.try_element_at(chunks, F.lit(1))


def first_chunk_answer(chunks: Column) -> Column:
    answer = first_chunk(chunks)
    return F.struct(answer.alias("answer"), answer.isNotNull().alias("ok"))


@dataclass(frozen=True)
class Parser:
    columns: Callable[[Column], Column]
    readable: Callable[[Any], bool]


def _holds(*markers: str) -> Callable[[str], bool]:
    return lambda text: all(marker in text for marker in markers)


# The next two say what ``parse_labels`` and ``parse_rubric`` say in their ``ok``, by the
# same splits, so that a response is asked for again exactly when it does not parse.


def _part(text: str | None, marker: str, n: int) -> str | None:
    parts = [] if text is None else text.split(marker)
    return parts[n] if n < len(parts) else None


# What a cast to a whole number strips: blanks and control characters.
_TRIMMED = "".join(map(chr, [*range(0x21), 0x7F]))


def _is_int(text: str | None) -> bool:
    digits = "" if text is None else text.strip(_TRIMMED)
    return re.fullmatch(r"[+-]?[0-9]+", digits) is not None and -(1 << 31) <= int(digits) < 1 << 31


def _readable_labels(text: str) -> bool:
    return (
        _part(_part(text, "\n", 0), OPTION_MARKER, 1) in OPTION_KEYS
        and _part(_part(text, "\n", 1), OPTION_MARKER, 1) in OPTION_KEYS
        and _part(text, PAIR_MARKERS[0], 1) is not None
        and _part(_part(text, "\n", 2), OPTION_ANSWER_MARKER, 1) is not None
    )


def _readable_rubric(text: str) -> bool:
    first, second, third = RUBRIC_MARKERS
    return (
        _is_int(_part(_part(text, first, 1), second, 0))
        and _is_int(_part(_part(text, second, 1), third, 0))
        and _is_int(_part(text, third, 1))
    )


RUBRIC = Parser(parse_rubric, _readable_rubric)
PAIR = Parser(parse_qa_pair, _holds(*PAIR_MARKERS))
LABELS = Parser(parse_labels, _readable_labels)
ANSWER = Parser(extract_answer, _holds(ANSWER_MARKER))
FIRST_CHUNK = Parser(first_chunk_answer, lambda chunks: len(chunks) > 0)


def parsed(df: DataFrame, parser, response: str = "response") -> DataFrame:
    """Replace the response column by the parser's columns."""
    kept = [c for c in df.columns if c != response]
    return df.select(*kept, parser(F.col(response)).alias("_p")).select(*kept, "_p.*")


def drop_unparsed(df: DataFrame) -> DataFrame:
    return df.where(F.col("ok")).drop("ok")
