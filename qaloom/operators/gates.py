"""Row filters. All are plain predicates that reach the scan where the source allows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from qaloom.functions.text import contains_text, parse_score, text_length
from qaloom.operators.stats import histogram_quantile
from qaloom.schemas import (
    DROP_MARKERS,
    HIGH_QUANTILE,
    LOW_QUANTILE,
    MAX_LENGTH,
    MIN_LENGTH,
    MIN_SCORE,
)

# Character ranges of scripts, as regular-expression classes.
SCRIPTS = {
    "kana": "[぀-ヿ]",
    "latin": "[A-Za-z]",
    "latin_accented": "[À-ɏ]",
}


def length_quantile_band(
    df: DataFrame, low: float = LOW_QUANTILE, high: float = HIGH_QUANTILE
) -> DataFrame:
    """Rows whose output length lies strictly between two index quantiles.

    The thresholds are one scalar subquery over the length histogram: two passes over
    the data, no join.
    """
    length = text_length(F.col("output"))
    bounds = histogram_quantile(df.select(length.alias("length")), "length", {"lo": low, "hi": high})
    pair = bounds.select(F.struct("lo", "hi")).scalar()
    return df.where((length > pair.getField("lo")) & (length < pair.getField("hi")))


def has_marker(text: Column, markers: list[str] | None = None) -> Column:
    hit = F.lit(False)
    for marker in markers if markers is not None else DROP_MARKERS:
        hit = hit | contains_text(text, marker)
    return hit


def drop_marked(df: DataFrame, markers: list[str] | None = None) -> DataFrame:
    """Drop rows whose output contains any of the literal markers."""
    return df.where(~has_marker(F.col("output"), markers))


def in_length_range(text: Column, low: int = MIN_LENGTH, high: int = MAX_LENGTH) -> Column:
    return text_length(text).between(low, high)


def length_range(df: DataFrame, low: int = MIN_LENGTH, high: int = MAX_LENGTH) -> DataFrame:
    """Output length within the range, both ends included."""
    return df.where(in_length_range(F.col("output"), low, high))


def score_gate(df: DataFrame, minimum: float = MIN_SCORE) -> DataFrame:
    """Average score at least the minimum; an unreadable score does not pass."""
    return df.where(parse_score(F.col("average_score")) >= minimum)


def category_in(df: DataFrame, categories: list[str]) -> DataFrame:
    return df.where(F.col("category").isin(categories))


def drop_unknown_category(df: DataFrame, categories: list[str]) -> DataFrame:
    """Leave out rows of categories that are not listed."""
    return category_in(df, categories)


def require_question2(wide: DataFrame) -> DataFrame:
    return wide.where(F.col("q2").isNotNull())


def foreign_script_filter(
    df: DataFrame, scripts: list[str] | None = None, max_share: float = 0.0
) -> DataFrame:
    """Drop rows whose output has more than ``max_share`` characters of the scripts.

    By default the scripts are those of Japanese and English. A NULL output has no
    characters and stays, whatever the share.
    """
    wanted = "|".join(SCRIPTS[s] for s in (scripts or ["kana", "latin"]))
    text = F.col("output")
    if max_share == 0.0:
        return df.where(F.coalesce(~text.rlike(wanted), F.lit(True)))
    share = F.regexp_count(text, F.lit(wanted)) / F.nullif(text_length(text), F.lit(0))
    return df.where(F.coalesce(share, F.lit(0.0)) <= max_share)


def resume_pending(df: DataFrame, done: DataFrame, key: str = "row_id") -> DataFrame:
    """Rows that are not yet among the finished ones."""
    return df.join(done.select(key), key, "left_anti")
