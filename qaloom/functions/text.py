"""Literal text expressions; everything here stays in generated JVM code."""

from __future__ import annotations

import string

from pyspark.sql import Column, functions as F


def contains_text(text: Column, marker: str) -> Column:
    return F.contains(text, F.lit(marker))


def marker_count(text: Column, marker: str) -> Column:
    """How often ``marker`` occurs without overlap."""
    removed = F.length(text) - F.length(F.replace(text, F.lit(marker), F.lit("")))
    return (removed / F.lit(len(marker))).cast("int")


def marker_split(text: Column, marker: str, n: int) -> Column:
    """Part ``n`` (from 0) between literal markers; NULL when there is no such part."""
    part = F.split_part(text, F.lit(marker), F.lit(n + 1))
    if n == 0:
        return part
    present = contains_text(text, marker) if n == 1 else marker_count(text, marker) >= n
    return F.when(present, part)


def parse_int(text: Column) -> Column:
    """Whole number with optional sign and surrounding blanks, else NULL."""
    return text.try_cast("int")


def parse_score(value: Column) -> Column:
    """Score as a double, whether the file holds text or a number."""
    return value.try_cast("double")


def format_score(score: Column) -> Column:
    """Score text with two decimals, as the files carry it; NULL stays NULL."""
    return F.when(score.isNotNull(), F.format_string("%.2f", score))


def text_length(text: Column) -> Column:
    """Number of code points."""
    return F.length(text)


def fill(template: str, **slots: Column) -> Column:
    """Fill ``{slot}`` places; a missing value prints as empty text."""
    pieces: list[Column] = []
    for literal, slot, _, _ in string.Formatter().parse(template):
        if literal:
            pieces.append(F.lit(literal))
        if slot is not None:
            pieces.append(F.coalesce(slots[slot].cast("string"), F.lit("")))
    return F.concat(*pieces)
