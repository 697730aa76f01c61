"""Projections: reshapes, prompts and parsers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from qaloom.catalog import adapters as a
from qaloom.catalog import standins
from qaloom.catalog.registry import query
from qaloom.functions import templates as t
from qaloom.operators import gates, prompts, reshape, responses
from qaloom.operators.generation import correct_text, spread
from qaloom.functions.text import format_score, marker_count, marker_split, parse_int
from qaloom.schemas import ANSWER_MARKER


@query(
    "row_to_record",
    f"""WITH {a.QA_CONV}
    SELECT row_id, input, output, category FROM qa_conv""",
)
def row_to_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = a.qa_conv(spark, sf_dir)
    records = reshape.row_to_record(rows)
    return records.select(
        F.from_json("record", "row_id long, input string, output string, category string").alias("r")
    ).select("r.*")


_UNPIVOT = "\nUNION ALL\n".join(
    f"SELECT row_id, {n} AS a_no, {q} AS q_no, q{q} AS input, a{n} AS output, category "
    f"FROM wide_qa{' WHERE q2 IS NOT NULL' if q == 2 else ''}"
    for n in range(1, 6)
    for q in (1, 2)
)


@query("unpivot_answers", f"WITH {a.WIDE_QA}\n{_UNPIVOT}")
def unpivot_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshape.unpivot_answers(a.wide_qa(spark, sf_dir))


@query("require_question2", f"WITH {a.WIDE_QA} SELECT row_id, q1, q2, category FROM wide_qa WHERE q2 IS NOT NULL")
def require_question2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.require_question2(a.wide_qa(spark, sf_dir)).select("row_id", "q1", "q2", "category")


def option_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.col("row_id")
    first = (
        F.when(r % 8 == 0, F.lit("1. A9"))
        .when(r % 9 == 0, F.lit("1. A1 \n2. A2\n3. Q: x A: y"))
        .otherwise(
            F.concat(
                F.lit("1. A"), (r % 5 + 1).cast("string"),
                F.lit("\n2. A"), ((r + 2) % 5 + 1).cast("string"),
                F.lit("\n3. Q: q"), r.cast("string"), F.lit(" A: a"), r.cast("string"),
            )
        )
    )
    return a.wide_qa(spark, sf_dir).withColumn("response", first)


_OPTIONS = f"""{a.WIDE_QA},
option_responses AS (
  SELECT *, CASE WHEN row_id % 8 = 0 THEN '1. A9'
    WHEN row_id % 9 = 0 THEN '1. A1 ' || chr(10) || '2. A2' || chr(10) || '3. Q: x A: y'
    ELSE '1. A' || (row_id % 5 + 1) || chr(10) || '2. A' || ((row_id + 2) % 5 + 1)
         || chr(10) || '3. Q: q' || row_id || ' A: a' || row_id END AS response
  FROM wide_qa),
lines AS (
  SELECT *, string_split(response, chr(10)) AS l FROM option_responses),
labels AS (
  SELECT * EXCLUDE (l, response),
    CASE WHEN contains(l[1], '. ') THEN split_part(l[1], '. ', 2) END AS k1,
    CASE WHEN contains(l[2], '. ') THEN split_part(l[2], '. ', 2) END AS k2,
    CASE WHEN contains(response, 'Q: ')
         THEN split_part(split_part(response, 'Q: ', 2), ' A: ', 1) END AS new_question,
    CASE WHEN contains(l[3], ' A: ') THEN split_part(l[3], ' A: ', 2) END AS new_answer
  FROM lines),
checked AS (
  SELECT *, coalesce(k1 IN ('A1','A2','A3','A4','A5') AND k2 IN ('A1','A2','A3','A4','A5')
         AND new_question IS NOT NULL AND new_answer IS NOT NULL, false) AS ok
  FROM labels)"""


@query("parse_labels", f"WITH {_OPTIONS} SELECT row_id, k1, k2, new_question AS q3, new_answer AS a3, ok FROM checked")
def parse_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = option_responses(spark, sf_dir).select("row_id", "response")
    return responses.parsed(rows, responses.parse_labels)


_PICK = "CASE {k} WHEN 'A1' THEN a1 WHEN 'A2' THEN a2 WHEN 'A3' THEN a3 WHEN 'A4' THEN a4 WHEN 'A5' THEN a5 END"


@query(
    "pick_option",
    f"WITH {_OPTIONS} SELECT row_id, k1, {_PICK.format(k='k1')} AS picked FROM checked",
)
def pick_option(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = option_responses(spark, sf_dir)
    label = responses.parse_labels(F.col("response")).getField("k1")
    return rows.withColumn("k1", label).select(
        "row_id", "k1", reshape.pick_option(F.col("k1")).alias("picked")
    )


_EXPAND = f"""
SELECT row_id, 1 AS label_no, q1 AS input, {_PICK.format(k='k1')} AS output, category FROM checked WHERE ok
UNION ALL
SELECT row_id, 2, q2, {_PICK.format(k='k2')}, category FROM checked WHERE ok
UNION ALL
SELECT row_id, 3, new_question, new_answer, category FROM checked WHERE ok"""


@query("expand_labels", f"WITH {_OPTIONS} {_EXPAND}")
def expand_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = option_responses(spark, sf_dir)
    labels = responses.parsed(rows.select("row_id", "response"), responses.parse_labels)
    return reshape.expand_labels(rows.drop("response"), labels)


def pair_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("row_id")
    question = F.concat(F.lit("Q: "), F.col("input"))
    whole = F.concat(question, F.lit("\nA: "), F.col("output"))
    text = F.when(d % 10 == 0, F.lit("nothing")).when(d % 9 == 0, question).otherwise(whole)
    return a.qa_docs(spark, sf_dir).select("row_id", text.alias("response"))


_PAIRS = f"""{a.QA_DOCS},
pair_responses AS (
  SELECT row_id, CASE WHEN row_id % 10 = 0 THEN 'nothing'
    WHEN row_id % 9 = 0 THEN 'Q: ' || input
    ELSE 'Q: ' || input || chr(10) || 'A: ' || output END AS response
  FROM qa_docs),
pairs AS (
  SELECT row_id,
    split_part(split_part(response, 'Q: ', 2), chr(10) || 'A: ', 1) AS input,
    split_part(response, chr(10) || 'A: ', 2) AS output,
    contains(response, 'Q: ') AND contains(response, chr(10) || 'A: ') AS ok
  FROM pair_responses)"""


@query(
    "parse_qa_pair",
    f"""WITH {_PAIRS} SELECT row_id, CASE WHEN ok THEN input END AS input,
    CASE WHEN ok THEN output END AS output, ok FROM pairs""",
)
def parse_qa_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return responses.parsed(pair_responses(spark, sf_dir), responses.parse_qa_pair)


@query("drop_unparsed", f"WITH {_PAIRS} SELECT row_id, input, output FROM pairs WHERE ok")
def drop_unparsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return responses.drop_unparsed(
        responses.parsed(pair_responses(spark, sf_dir), responses.parse_qa_pair)
    )


@query(
    "marker_split",
    """SELECT doc_id, CASE WHEN len(string_split(text, '. ')) > 2 THEN string_split(text, '. ')[3] END AS part,
      CAST((length(text) - length(replace(text, '. ', ''))) // 2 AS INTEGER) AS markers
    FROM documents""",
)
def marker_split_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return a.table(spark, sf_dir, "documents").select(
        "doc_id",
        marker_split(text, ". ", 2).alias("part"),
        marker_count(text, ". ").alias("markers"),
    )


@query(
    "parse_int",
    f"""WITH tokens AS (SELECT doc_id, split_part(source, 'src', 2) AS token FROM documents)
    SELECT doc_id, token, {a.sql_int("token")} AS number FROM tokens""",
)
def parse_int_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    token = F.split_part("source", F.lit("src"), F.lit(2))
    return a.table(spark, sf_dir, "documents").select(
        "doc_id", token.alias("token"), parse_int(token).alias("number")
    )


@query(
    "parse_rubric",
    f"""WITH {a.PARSED_RUBRIC}
    SELECT row_id, accuracy, completeness, naturalness, round(average, 6) AS average, ok FROM rubric""",
)
def parse_rubric(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = a.rubric_responses(spark, sf_dir).select("row_id", "response")
    return responses.parsed(rows, responses.parse_rubric).withColumn(
        "average", F.round("average", 6)
    )


@query(
    "format_score",
    f"WITH {a.SCORED_DOCS} SELECT row_id, printf('%.2f', average_score) AS score_text FROM scored_docs",
)
def format_score_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return a.scored_docs(spark, sf_dir).select(
        "row_id", format_score(F.col("average_score")).alias("score_text")
    )


_OPTION_SLOTS = {c: c for c in ("q1", "q2", "a1", "a2", "a3", "a4", "a5")}
OPTION_PROMPT_SQL = f"{a.sql_text(t.OPTION_SYSTEM + chr(10))} || {a.sql_fill(t.OPTION_USER, **_OPTION_SLOTS)}"


@query("build_option_prompt", f"WITH {a.WIDE_QA} SELECT row_id, {OPTION_PROMPT_SQL} AS prompt FROM wide_qa")
def build_option_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prompts.build_option_prompt(a.wide_qa(spark, sf_dir))


@query(
    "build_option_messages",
    f"""WITH {a.WIDE_QA}
    SELECT row_id, 'system' AS role, {a.sql_text(t.OPTION_SYSTEM)} AS content FROM wide_qa
    UNION ALL
    SELECT row_id, 'user', {a.sql_fill(t.OPTION_USER, **_OPTION_SLOTS)} FROM wide_qa""",
)
def build_option_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prompts.build_option_messages(a.wide_qa(spark, sf_dir)).select(
        "row_id", F.inline("messages")
    )


PAIR_PROMPT_SQL = a.sql_fill(t.PAIR, q1="q1", a1="a1", q2="q2", a2="a2")


@query(
    "build_pair_prompt",
    f"""WITH {a.WIDE_QA}
    SELECT row_id, {PAIR_PROMPT_SQL} AS prompt FROM wide_qa""",
)
def build_pair_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prompts.build_pair_prompt(a.wide_qa(spark, sf_dir), ["row_id"])


RUBRIC_PROMPT_SQL = a.sql_fill(t.RUBRIC, question="input", answer="output")


@query("build_rubric_prompt", f"WITH {a.QA_CONV} SELECT row_id, {RUBRIC_PROMPT_SQL} AS prompt FROM qa_conv")
def build_rubric_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prompts.build_rubric_prompt(a.qa_conv(spark, sf_dir), ["row_id"])


ANSWER_PROMPT_SQL = a.sql_fill(
    t.ANSWER, instruction=a.sql_text(t.ANSWER_INSTRUCTION), question="question"
)


@query("build_answer_prompt", f"WITH {a.QUESTIONS} SELECT id, {ANSWER_PROMPT_SQL} AS prompt FROM questions")
def build_answer_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prompts.build_answer_prompt(a.questions(spark, sf_dir))


CONTEXT_PROMPT_SQL = a.sql_fill(
    t.CONTEXT,
    instruction=a.sql_text(t.ANSWER_INSTRUCTION),
    context="context",
    question="question",
)


@query(
    "build_context_prompt",
    f"""WITH {a.QUESTIONS}, {a.QA_DOCS},
    contexts AS (SELECT 'T' || row_id AS id, output AS context FROM qa_docs)
    SELECT id, {CONTEXT_PROMPT_SQL} AS prompt
    FROM questions LEFT JOIN contexts USING (id)""",
)
def build_context_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    contexts = a.qa_docs(spark, sf_dir).select(
        F.concat(F.lit("T"), F.col("row_id").cast("string")).alias("id"),
        F.col("output").alias("context"),
    )
    return prompts.build_context_prompt(a.questions(spark, sf_dir), contexts)


TRAINING_TEXT_SQL = a.sql_fill(
    t.TRAINING, instruction=a.sql_text(t.TRAINING_INSTRUCTION), input="input", output="output"
)


@query("instruction_text", f"WITH {a.QA_CONV} SELECT *, {TRAINING_TEXT_SQL} AS text FROM qa_conv")
def instruction_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshape.instruction_text(a.qa_conv(spark, sf_dir))


@query(
    "format_passage",
    f"WITH {a.PASSAGES} SELECT doc_id, page_content AS passage FROM passages",
)
def format_passage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshape.format_passage(a.qa_docs(spark, sf_dir))


@query(
    "extract_answer",
    f"""WITH {a.QA_CONV}, texts AS (
      SELECT row_id, CASE WHEN category = 'c0' THEN input
        ELSE {TRAINING_TEXT_SQL} || {a.sql_text(ANSWER_MARKER)} || 'again' END AS text
      FROM qa_conv)
    SELECT row_id,
      CASE WHEN contains(text, {a.sql_text(ANSWER_MARKER)})
           THEN split_part(text, {a.sql_text(ANSWER_MARKER)}, 2) END AS answer,
      contains(text, {a.sql_text(ANSWER_MARKER)}) AS ok
    FROM texts""",
)
def extract_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reshape.instruction_text(a.qa_conv(spark, sf_dir))
    text = F.when(F.col("category") == "c0", F.col("input")).otherwise(
        F.concat(F.col("text"), F.lit(ANSWER_MARKER + "again"))
    )
    return responses.parsed(
        rows.select("row_id", text.alias("response")), responses.extract_answer
    )


@query(
    "first_chunk",
    "SELECT doc_id, string_split(text, chr(10))[1] AS chunk FROM documents",
)
def first_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = F.split("text", "\n", -1)
    return a.table(spark, sf_dir, "documents").select(
        "doc_id", responses.first_chunk(chunks).alias("chunk")
    )


_CORRECTED = f"""corrected AS (
  SELECT row_id, category, input AS i, output AS o,
    {standins.sql_correct("input")} AS ci, {standins.sql_correct("output")} AS co
  FROM qa_docs)"""


@query(
    "correction_audit",
    f"""WITH {a.QA_DOCS}, {_CORRECTED}
    SELECT row_id, category, ci AS input, co AS output, (ci <> i OR co <> o) AS is_corrected,
      CASE WHEN ci <> i OR co <> o THEN i ELSE '' END AS before_input,
      CASE WHEN ci <> i OR co <> o THEN o ELSE '' END AS before_output
    FROM corrected WHERE ci IS NOT NULL AND co IS NOT NULL""",
)
def correction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    def clean(column: str):
        text = F.col(column)
        return F.when(~F.contains(text, F.lit("@")), F.regexp_replace(text, " +", " "))

    rows = a.qa_docs(spark, sf_dir).withColumns(
        {"corrected_input": clean("input"), "corrected_output": clean("output")}
    )
    return reshape.correction_audit(rows)


@query(
    "correct_text",
    f"""WITH {a.QA_DOCS}, {_CORRECTED}
    SELECT row_id, category, ci AS input, co AS output, (ci <> i OR co <> o) AS is_corrected,
      CASE WHEN ci <> i OR co <> o THEN i ELSE '' END AS before_input,
      CASE WHEN ci <> i OR co <> o THEN o ELSE '' END AS before_output
    FROM corrected WHERE ci IS NOT NULL AND co IS NOT NULL""",
)
def correct_text_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correct_text(spread(a.qa_docs(spark, sf_dir), ["row_id"]), standins.correct)


@query(
    "vector_to_columns",
    "SELECT vec_id AS id, "
    + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS c{i}" for i in range(a.COMPONENTS))
    + " FROM embeddings",
)
def vector_to_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshape.vector_to_columns(a.vector_queries(spark, sf_dir), a.COMPONENTS)


@query(
    "constant_labels",
    f"""WITH {a.QA_CONV}
    SELECT row_id, input, output, '부정라벨링' AS category, 2.0::DOUBLE AS average_score FROM qa_conv""",
)
def constant_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshape.constant_labels(a.qa_conv(spark, sf_dir))


@query(
    "union_generated",
    f"""WITH {a.QA_DOCS}, {a.QA_CONV}
    SELECT row_id, input, output, category, NULL::DOUBLE AS average_score FROM qa_docs
    UNION ALL SELECT row_id, input, output, category, NULL FROM qa_docs
    UNION ALL SELECT row_id, input, output, category, 3.0 FROM qa_conv""",
)
def union_generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = a.qa_docs(spark, sf_dir)
    conv = a.qa_conv(spark, sf_dir).withColumn("average_score", F.lit(3.0))
    return reshape.union_generated(docs, docs, conv)


@query(
    "sort_by_category",
    f"WITH {a.QA_CONV} SELECT * FROM qa_conv ORDER BY category, row_id",
)
def sort_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshape.sort_by_category(a.qa_conv(spark, sf_dir))


@query("preview", f"WITH {a.QA_DOCS} SELECT * FROM qa_docs ORDER BY row_id LIMIT 5")
def preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshape.preview(a.qa_docs(spark, sf_dir))
