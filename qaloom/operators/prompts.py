"""Prompt columns filled from row values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from qaloom.functions import templates as t
from qaloom.functions.text import fill


def option_prompt(template: str = t.OPTION_USER, system: str = t.OPTION_SYSTEM) -> Column:
    slots = {c: F.col(c) for c in ("q1", "q2", "a1", "a2", "a3", "a4", "a5")}
    return F.concat(F.lit(system + "\n"), fill(template, **slots))


def build_option_prompt(
    wide: DataFrame, template: str = t.OPTION_USER, system: str = t.OPTION_SYSTEM
) -> DataFrame:
    """Two questions and five options as one prompt."""
    return wide.select("row_id", option_prompt(template, system).alias("prompt"))


def build_option_messages(
    wide: DataFrame, template: str = t.OPTION_USER, system: str = t.OPTION_SYSTEM
) -> DataFrame:
    """The same prompt as a list of (role, content) messages."""
    slots = {c: F.col(c) for c in ("q1", "q2", "a1", "a2", "a3", "a4", "a5")}
    messages = F.array(
        F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")),
        F.struct(F.lit("user").alias("role"), fill(template, **slots).alias("content")),
    )
    return wide.select("row_id", messages.alias("messages"))


def pair_prompt(template: str = t.PAIR) -> Column:
    return fill(template, **{c: F.col(c) for c in ("q1", "a1", "q2", "a2")})


def build_pair_prompt(pairs: DataFrame, keys: list[str], template: str = t.PAIR) -> DataFrame:
    return pairs.select(*keys, pair_prompt(template).alias("prompt"))


def rubric_prompt(template: str = t.RUBRIC) -> Column:
    return fill(template, question=F.col("input"), answer=F.col("output"))


def build_rubric_prompt(
    qa: DataFrame, keys: list[str], template: str = t.RUBRIC
) -> DataFrame:
    return qa.select(*keys, rubric_prompt(template).alias("prompt"))


def answer_prompt(instruction: str = t.ANSWER_INSTRUCTION, template: str = t.ANSWER) -> Column:
    return fill(template, instruction=F.lit(instruction), question=F.col("question"))


def build_answer_prompt(
    questions: DataFrame,
    key: str = "id",
    instruction: str = t.ANSWER_INSTRUCTION,
    template: str = t.ANSWER,
) -> DataFrame:
    return questions.select(key, answer_prompt(instruction, template).alias("prompt"))


def build_context_prompt(
    questions: DataFrame,
    contexts: DataFrame,
    key: str = "id",
    instruction: str = t.ANSWER_INSTRUCTION,
    template: str = t.CONTEXT,
    carry: list[str] | None = None,
) -> DataFrame:
    """Retrieved context and question; a question without hits has an empty context.

    ``carry`` names columns of the questions that stay beside the prompt.
    """
    text = fill(
        template,
        instruction=F.lit(instruction),
        context=F.col("context"),
        question=F.col("question"),
    )
    return questions.join(contexts.select(key, "context"), key, "left").select(
        key, *(carry or []), text.alias("prompt")
    )
