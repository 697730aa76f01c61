"""The given tables in the shapes the operators take, in Spark and in SQL.

Each adapter reads its whole table. The SQL side is a common table expression.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession, functions as F

from qaloom.functions.text import fill
from qaloom.operators import responses
from qaloom.schemas import DEFAULT_SCORE, PASSAGE_FORMAT, RUBRIC_MARKERS

LANGS = ["en", "fr", "de", "es"]
MINOR_LANGS = ["de", "es"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sql_fill(template: str, **slots: str) -> str:
    """The SQL form of ``fill``."""
    pieces = []
    for literal, slot, _, _ in string.Formatter().parse(template):
        if literal:
            pieces.append(sql_text(literal))
        if slot is not None:
            pieces.append(f"coalesce({slots[slot]}, '')")
    return " || ".join(pieces)


def sql_hash(key: str, seed: str) -> str:
    return f"md5(({key}) || '|{seed}')"


def sql_draw(digest: str, n: str) -> str:
    return f"(('0x' || substr({digest}, 1, 15))::BIGINT % ({n}))"


def qa_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as question (first line), answer (whole text), category (language)."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("row_id"),
        F.split_part("text", F.lit("\n"), F.lit(1)).alias("input"),
        F.col("text").alias("output"),
        F.col("lang").alias("category"),
    )


QA_DOCS = """qa_docs AS (
  SELECT doc_id AS row_id, split_part(text, chr(10), 1) AS input, text AS output,
         lang AS category
  FROM documents)"""


def qa_conv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user turn and the assistant turn right after it.

    Turns join on (conversation, turn): a long conversation spreads over the partitions.
    """
    turns = table(spark, sf_dir, "conversations")
    user = turns.where(F.col("role") == "user").select(
        "conv_id", "turn", F.col("text").alias("input")
    )
    reply = turns.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("output")
    )
    return user.join(reply, ["conv_id", "turn"]).select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("row_id"),
        "input",
        "output",
        F.concat(F.lit("c"), (F.col("conv_id") % 7).cast("string")).alias("category"),
    )


QA_CONV = """qa_conv AS (
  SELECT u.conv_id * 1000 + u.turn AS row_id, u.text AS input, a.text AS output,
         'c' || (u.conv_id % 7) AS category
  FROM conversations u
  JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant')"""


def wide_qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven documents in a row make one wide row: two questions and five answers.

    The second question is there where its document has the row's language.
    """
    docs = table(spark, sf_dir, "documents").select(
        F.floor(F.col("doc_id") / 7).alias("row_id"), (F.col("doc_id") % 7).alias("slot"), "text", "lang"
    )

    def at(slot: int, column: str):
        return F.max(F.when(F.col("slot") == slot, F.col(column)))

    return (
        docs.groupBy("row_id")
        .agg(
            at(0, "text").alias("q1"),
            F.when(at(1, "lang") == at(0, "lang"), at(1, "text")).alias("q2"),
            *[at(i + 1, "text").alias(f"a{i}") for i in range(1, 6)],
            at(0, "lang").alias("category"),
        )
    )


def _sql_slot(slot: int, column: str) -> str:
    return f"max(CASE WHEN doc_id % 7 = {slot} THEN {column} END)"


WIDE_QA = f"""wide_qa AS (
  SELECT doc_id // 7 AS row_id, {_sql_slot(0, "text")} AS q1,
         CASE WHEN {_sql_slot(1, "lang")} = {_sql_slot(0, "lang")}
              THEN {_sql_slot(1, "text")} END AS q2,
         {", ".join(f"{_sql_slot(i + 1, 'text')} AS a{i}" for i in range(1, 6))},
         {_sql_slot(0, "lang")} AS category
  FROM documents GROUP BY doc_id // 7)"""


def rubric_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rubric response per document, some unreadable, some with a broken mark."""
    first, second, third = RUBRIC_MARKERS
    n, d = F.col("n_chars"), F.col("doc_id")
    accuracy = F.when(d % 13 == 0, F.lit("4.5")).otherwise((n % 6).cast("string"))
    text = F.concat(
        F.lit(first), accuracy,
        F.lit(second), ((n + d) % 6).cast("string"),
        F.lit(third), (d % 6).cast("string"),
    )
    return table(spark, sf_dir, "documents").select(
        d.alias("row_id"),
        F.col("lang").alias("category"),
        F.col("text").alias("output"),
        F.when(d % 11 == 0, F.lit("no marks")).otherwise(text).alias("response"),
    )


RUBRIC_RESPONSES = f"""rubric_responses AS (
  SELECT doc_id AS row_id, lang AS category, text AS output,
         CASE WHEN doc_id % 11 = 0 THEN 'no marks' ELSE
           {sql_text(RUBRIC_MARKERS[0])}
           || CASE WHEN doc_id % 13 = 0 THEN '4.5' ELSE CAST(n_chars % 6 AS VARCHAR) END
           || {sql_text(RUBRIC_MARKERS[1])} || ((n_chars + doc_id) % 6)
           || {sql_text(RUBRIC_MARKERS[2])} || (doc_id % 6) END AS response
  FROM documents)"""

_MARKS = [
    f"split_part(split_part(response, {sql_text(RUBRIC_MARKERS[0])}, 2), {sql_text(RUBRIC_MARKERS[1])}, 1)",
    f"split_part(split_part(response, {sql_text(RUBRIC_MARKERS[1])}, 2), {sql_text(RUBRIC_MARKERS[2])}, 1)",
    f"split_part(response, {sql_text(RUBRIC_MARKERS[2])}, 2)",
]


def sql_int(text: str) -> str:
    return (
        f"CASE WHEN regexp_full_match(trim({text}), '[+-]?[0-9]+') "
        f"THEN CAST(trim({text}) AS INTEGER) END"
    )


PARSED_RUBRIC = f"""{RUBRIC_RESPONSES},
marks AS (
  SELECT row_id, category, output, {sql_int(_MARKS[0])} AS accuracy,
         {sql_int(_MARKS[1])} AS completeness, {sql_int(_MARKS[2])} AS naturalness
  FROM rubric_responses),
rubric AS (
  SELECT *, CAST(accuracy + completeness + naturalness AS DOUBLE) / 3 AS average,
         (accuracy + completeness + naturalness) IS NOT NULL AS ok
  FROM marks)"""


def scored_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the score their rubric response gives, or the default."""
    rows = responses.parsed(rubric_responses(spark, sf_dir), responses.parse_rubric)
    return rows.select(
        "row_id",
        "category",
        "output",
        F.coalesce("average", F.lit(DEFAULT_SCORE)).alias("average_score"),
    )


SCORED_DOCS = f"""{PARSED_RUBRIC},
scored_docs AS (
  SELECT row_id, category, output, coalesce(average, 3.0) AS average_score FROM rubric)"""


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as test questions."""
    return table(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("T"), F.col("item_id").cast("string")).alias("id"),
        F.col("text").alias("question"),
    )


QUESTIONS = "questions AS (SELECT 'T' || item_id AS id, text AS question FROM benchmark)"


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = fill(PASSAGE_FORMAT, input=F.col("input"), output=F.col("output"))
    return qa_docs(spark, sf_dir).select(F.col("row_id").alias("doc_id"), text.alias("page_content"))


PASSAGES = f"""{QA_DOCS},
passages AS (
  SELECT row_id AS doc_id, {sql_fill(PASSAGE_FORMAT, input="input", output="output")} AS page_content
  FROM qa_docs)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


COMPONENTS = 64


def template(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A submission template with one line per document and a number in every column."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("row_id"),
        F.concat(F.lit("T"), F.col("doc_id").cast("string")).alias("id"),
        *[(F.col("n_chars") / F.lit(i + 1)).alias(f"c{i}") for i in range(COMPONENTS)],
    )


TEMPLATE = f"""template AS (
  SELECT doc_id AS row_id, 'T' || doc_id AS id,
         {", ".join(f"CAST(n_chars AS DOUBLE) / {i + 1} AS c{i}" for i in range(COMPONENTS))}
  FROM documents)"""
