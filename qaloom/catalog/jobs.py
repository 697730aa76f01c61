"""Composite jobs, with the offline stand-ins for the models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from qaloom.catalog import adapters as a
from qaloom.catalog import standins
from qaloom.catalog.curation import BAND, REPORT, UNMARKED
from qaloom.catalog.pairs import SEED, sql_folds, sql_partner, sql_pool
from qaloom.catalog.registry import query
from qaloom.catalog.text import (
    ANSWER_PROMPT_SQL,
    CONTEXT_PROMPT_SQL,
    OPTION_PROMPT_SQL,
    PAIR_PROMPT_SQL,
    RUBRIC_PROMPT_SQL,
    TRAINING_TEXT_SQL,
)
from qaloom.lineage import scratch_path
from qaloom.operators import prompts, responses
from qaloom.operators.generation import generate_with_retry
from qaloom.plans import answering, augment, jobs
from qaloom.schemas import AUGMENT_ROUNDS
from qaloom.streaming.gates import stream_quality_gates


def _score_out(rows: DataFrame) -> DataFrame:
    return rows.withColumn("average_score", F.round("average_score", 6))


@query(
    "curate",
    f"""WITH {a.QA_DOCS}, {BAND},
    prompted AS (SELECT *, {RUBRIC_PROMPT_SQL} AS p FROM banded WHERE {UNMARKED}),
    scored AS (SELECT *, {standins.sql_score("p")} AS s, {standins.sql_never_scored("p")} AS d FROM prompted),
    corrected AS (
      SELECT *, {standins.sql_correct("input")} AS ci, {standins.sql_correct("output")} AS co
      FROM scored WHERE s >= 3)
    SELECT row_id, category, round(s, 6) AS average_score, d AS score_defaulted, ci AS input, co AS output,
      (ci <> input OR co <> output) AS is_corrected,
      CASE WHEN ci <> input OR co <> output THEN input ELSE '' END AS before_input,
      CASE WHEN ci <> input OR co <> output THEN output ELSE '' END AS before_output
    FROM corrected WHERE ci IS NOT NULL AND co IS NOT NULL""",
)
def curate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _score_out(
        jobs.curate(a.qa_docs(spark, sf_dir), standins.score, standins.correct)
    )


@query(
    "score_rows",
    f"""WITH {a.QA_CONV}, prompted AS (SELECT *, {RUBRIC_PROMPT_SQL} AS p FROM qa_conv)
    SELECT row_id, input, output, category, round({standins.sql_score("p")}, 6) AS average_score,
      {standins.sql_never_scored("p")} AS score_defaulted
    FROM prompted""",
)
def score_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _score_out(jobs.score_rows(a.qa_conv(spark, sf_dir), standins.score))


@query(
    "generate_with_retry",
    f"""WITH {a.QA_CONV}, prompted AS (SELECT row_id, {RUBRIC_PROMPT_SQL} AS p FROM qa_conv)
    SELECT row_id,
      CASE WHEN NOT ({standins.sql_never_scored("p")}) THEN round({standins.sql_score("p")}, 6) END AS average,
      NOT ({standins.sql_never_scored("p")}) AS ok,
      CAST(CASE WHEN {standins.sql_never_scored("p")} THEN 5 WHEN {standins.sql_scored_late("p")} THEN 3
           ELSE 1 END AS INTEGER) AS attempt
    FROM prompted""",
)
def generate_with_retry_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = prompts.build_rubric_prompt(a.qa_conv(spark, sf_dir), ["row_id"])
    made = generate_with_retry(
        asked, ["row_id"], standins.score, responses.RUBRIC, 5, on_fail="keep"
    )
    return made.select("row_id", F.round("average", 6).alias("average"), "ok", "attempt")


@query(
    "label_options",
    f"""WITH {a.WIDE_QA}, prompted AS (SELECT *, {OPTION_PROMPT_SQL} AS p FROM wide_qa),
    labelled AS (
      SELECT *, [a1, a2, a3, a4, a5] AS options, md5(p) AS h, length(p) AS n
      FROM prompted WHERE length(p) % 7 <> 0)
    SELECT row_id, 1 AS label_no, q1 AS input, options[n % 5 + 1] AS output, category FROM labelled
    UNION ALL SELECT row_id, 2, q2, options[(n + 2) % 5 + 1], category FROM labelled
    UNION ALL SELECT row_id, 3, 'q-' || h, 'a-' || h, category FROM labelled""",
)
def label_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.label_options(a.wide_qa(spark, sf_dir), standins.choose)


_OK, _QUESTION, _ANSWER = standins.sql_write_pair("p")


@query(
    "synthesize_pairs",
    f"""WITH {a.QA_DOCS}, {sql_partner('qa_docs', 1)},
    prompted AS (SELECT row_id, draw_no, category, {PAIR_PROMPT_SQL} AS p FROM partners)
    SELECT row_id, CAST(draw_no AS INTEGER) AS draw_no, {_QUESTION} AS input, {_ANSWER} AS output, category
    FROM prompted WHERE {_OK}""",
)
def synthesize_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.synthesize_pairs(a.qa_docs(spark, sf_dir), standins.write_pair, SEED)


_CANDIDATES = f"""{a.WIDE_QA}, unpivoted AS (
  SELECT row_id, category, a_no, q_no,
    CASE WHEN q_no = 1 THEN q1 ELSE q2 END AS input,
    [a1, a2, a3, a4, a5][a_no] AS output
  FROM wide_qa, (SELECT unnest(range(1, 6)) AS a_no) an, (SELECT unnest([1, 2]) AS q_no) qn
  WHERE q_no = 1 OR q2 IS NOT NULL),
prompted AS (
  SELECT *, {RUBRIC_PROMPT_SQL} AS p FROM unpivoted WHERE length(output) BETWEEN 100 AND 300),
candidates AS (
  SELECT row_id, a_no, q_no, input, output, category, {standins.sql_score("p")} AS average_score,
    {standins.sql_never_scored("p")} AS score_defaulted
  FROM prompted WHERE {standins.sql_score("p")} >= 3)"""


@query(
    "candidate_set",
    f"""WITH {_CANDIDATES}
    SELECT row_id, CAST(a_no AS INTEGER) AS a_no, q_no, input, output, category,
      round(average_score, 6) AS average_score, score_defaulted
    FROM candidates""",
)
def candidate_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = jobs.candidate_set(a.wide_qa(spark, sf_dir), standins.score)
    return _score_out(rows)


@query("candidate_report", f"WITH {_CANDIDATES}, {REPORT.format(table='candidates')}")
def candidate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, report = jobs.candidate_set(a.wide_qa(spark, sf_dir), standins.score)
    return report.withColumn("value", F.round("value", 6))


@query(
    "training_set",
    f"""WITH {a.QA_CONV}, texts AS (SELECT *, {TRAINING_TEXT_SQL} AS text FROM qa_conv),
    {sql_folds('texts')}
    SELECT * EXCLUDE (is_eval), CASE WHEN is_eval THEN 'eval' ELSE 'train' END AS side FROM folds""",
)
def training_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "training")
    folds = jobs.training_set(a.qa_conv(spark, sf_dir), SEED)
    jobs.write_training_set(folds, path)
    return spark.read.parquet(path)


def _augment_sql() -> str:
    """One recursion step is one round of all categories; a row carries what its category has made."""
    digest = lambda what: f"md5((round + 1) || '|' || category || '|{SEED}|{what}')"
    text = lambda alias, at, column: (
        f"CASE WHEN {at} < s.base THEN {alias}.{column} ELSE s.made[{at} - s.base + 1].{column} END"
    )
    return f"""WITH RECURSIVE {a.QA_DOCS}, {sql_pool("qa_docs", SEED)},
state AS (
  SELECT -1 AS round, category, count(*) AS base,
    CAST([] AS STRUCT(round INTEGER, idx BIGINT, input VARCHAR, output VARCHAR, average_score DOUBLE)[]) AS made
  FROM pool GROUP BY category
  UNION ALL
  SELECT round + 1, category, base,
    CASE WHEN drafted AND length(output) BETWEEN 100 AND 300 AND {standins.sql_score("p")} >= 3
      THEN list_append(made, {{'round': CAST(round + 1 AS INTEGER), 'idx': n, 'input': input, 'output': output,
        'average_score': round({standins.sql_score("p")}, 6)}})
      ELSE made END
  FROM (SELECT *, {RUBRIC_PROMPT_SQL} AS p FROM (
    SELECT * EXCLUDE (p), {_OK} AS drafted, {_QUESTION} AS input, {_ANSWER} AS output FROM (
      SELECT *, {PAIR_PROMPT_SQL} AS p FROM (
        SELECT s.round, s.category, s.base, s.made, s.n,
          {text("x", "s.i", "input")} AS q1, {text("x", "s.i", "output")} AS a1,
          {text("y", "s.j", "input")} AS q2, {text("y", "s.j", "output")} AS a2
        FROM (
          SELECT *, j0 + CAST(j0 >= i AS INTEGER) AS j FROM (
            SELECT *, {a.sql_draw(digest("first"), "n")} AS i, {a.sql_draw(digest("second"), "n - 1")} AS j0
            FROM (SELECT *, base + len(made) AS n FROM state WHERE round < {AUGMENT_ROUNDS - 1}) WHERE n >= 2)) s
        LEFT JOIN pool x ON x.category = s.category AND x.idx = s.i
        LEFT JOIN pool y ON y.category = s.category AND y.idx = s.j)))))
SELECT unnest(made, recursive := true), category FROM state WHERE round = {AUGMENT_ROUNDS - 1}"""


@query("augment_rounds", _augment_sql())
def augment_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _score_out(
        augment.augment_rounds(
            a.qa_docs(spark, sf_dir), standins.write_pair, standins.score, SEED, categories=a.LANGS
        )
    )


@query(
    "answer_questions",
    f"""WITH {a.QUESTIONS}, prompted AS (SELECT *, {ANSWER_PROMPT_SQL} AS p FROM questions)
    SELECT id, question AS input, {standins.sql_answer("p")} AS output FROM prompted""",
)
def answer_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answering.answer_questions(a.questions(spark, sf_dir), standins.answer)


@query(
    "retrieve_and_answer",
    f"""WITH {a.PASSAGES}, {a.QUESTIONS},
    {standins.sql_embed("passages", "doc_id", "page_content", "pv")},
    {standins.sql_embed("questions", "id", "question", "qv")},
    distances AS (
      SELECT q.id, p.doc_id, sum((q.value - p.value) ** 2) AS distance
      FROM qv q JOIN pv p ON p.slot = q.slot GROUP BY q.id, p.doc_id),
    hits AS (
      SELECT * FROM (
        SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, doc_id) AS rank FROM distances)
      WHERE rank <= 4),
    contexts AS (
      SELECT h.id, string_agg(p.page_content, chr(10) || chr(10) ORDER BY h.rank) AS context
      FROM hits h JOIN passages p USING (doc_id) GROUP BY h.id),
    prompted AS (
      SELECT id, question, {CONTEXT_PROMPT_SQL} AS p FROM questions LEFT JOIN contexts USING (id))
    SELECT id, question AS input, {standins.sql_answer_in_chunks("p")} AS output FROM prompted""",
)
def retrieve_and_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = answering.build_index(a.passages(spark, sf_dir), standins.embed)
    return answering.retrieve_and_answer(
        a.questions(spark, sf_dir), index, standins.embed, standins.answer_in_chunks
    )


@query(
    "stream_quality_gates",
    f"""WITH {a.QA_CONV}, prompted AS (SELECT *, {RUBRIC_PROMPT_SQL} AS p FROM qa_conv),
    scored AS (SELECT *, {standins.sql_score("p")} AS s FROM prompted)
    SELECT row_id, category, input, output, printf('%.2f', s) AS average_score
    FROM scored WHERE s >= 3 AND {UNMARKED} AND length(output) BETWEEN 100 AND 300
      AND NOT contains(input, chr(10) || 'A: ') AND NOT contains(input, 'Q: ')""",
)
def stream_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two loads of files, a run after each: the second run adds only the new files."""
    root = scratch_path(spark, "stream")
    rows = a.qa_conv(spark, sf_dir)
    asked = prompts.build_rubric_prompt(rows, ["row_id"])
    marks = generate_with_retry(
        asked, ["row_id"], standins.score, _TEXT, max_attempts=3, on_fail="keep"
    )
    incoming = rows.join(marks, "row_id").select(
        "row_id",
        "category",
        F.concat(F.lit("Q: "), "input", F.lit("\nA: "), "output").alias("pair_response"),
        F.col("text").alias("score_response"),
    )
    for load in (F.col("category") == "c0", F.col("category") != "c0"):
        incoming.where(load).write.mode("append").json(f"{root}/in")
        stream_quality_gates(spark, f"{root}/in", f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return spark.read.schema(
        "row_id long, category string, input string, output string, average_score string"
    ).json(f"{root}/out")


def _as_text(response):
    return F.struct(
        response.alias("text"), responses.parse_rubric(response).getField("ok").alias("ok")
    )


_TEXT = responses.Parser(_as_text, responses.RUBRIC.readable)


