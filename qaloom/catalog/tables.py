"""Readers and writers: a given table goes out in a file format and comes back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from qaloom.catalog import adapters as a
from qaloom.catalog.registry import query
from qaloom.lineage import scratch_path
from qaloom.operators import reshape
from qaloom.schemas import PASSAGE_HEADER, QUESTION_HEADERS, WIDE_HEADERS
from qaloom.sources import readers, writers

_WIDE_COLUMNS = "q1, q2, a1, a2, a3, a4, a5, category"


@query(
    "scan_wide_qa",
    f"WITH {a.WIDE_QA} SELECT row_number() OVER (ORDER BY row_id) - 1 AS row_id, {_WIDE_COLUMNS} FROM wide_qa",
)
def scan_wide_qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "wide")
    wide = a.wide_qa(spark, sf_dir).orderBy("row_id")
    writers.write_csv(wide.select(*[F.col(c).alias(h) for h, c in WIDE_HEADERS.items()]), path)
    return readers.scan_wide_qa(spark, path)


@query(
    "scan_questions",
    f"WITH {a.QUESTIONS} SELECT row_number() OVER (ORDER BY id) - 1 AS row_id, id, question FROM questions",
)
def scan_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "questions")
    rows = a.questions(spark, sf_dir).orderBy("id")
    writers.write_csv(rows.select(*[F.col(c).alias(h) for h, c in QUESTION_HEADERS.items()]), path)
    return readers.scan_questions(spark, path)


@query(
    "scan_template",
    f"WITH {a.TEMPLATE} SELECT * FROM template",
)
def scan_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "template")
    writers.write_csv(a.template(spark, sf_dir).orderBy("row_id").drop("row_id"), path)
    return readers.scan_template(spark, path)


_RECORDS = f"WITH {a.QA_CONV} SELECT input, output, category FROM qa_conv"


@query("scan_jsonl", _RECORDS)
def scan_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "records")
    writers.write_jsonl(a.qa_conv(spark, sf_dir).drop("row_id"), path)
    return readers.scan_jsonl(spark, path)


@query(
    "write_jsonl",
    f"""WITH {a.SCORED_DOCS}
    SELECT row_id, category, output, printf('%.2f', average_score) AS average_score FROM scored_docs""",
)
def write_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "scored")
    writers.write_jsonl(a.qa_conv(spark, sf_dir), path)
    writers.write_jsonl(a.scored_docs(spark, sf_dir), path)
    return spark.read.schema(
        "row_id long, category string, output string, average_score string"
    ).json(path)


@query("append_jsonl", f"WITH {a.QA_CONV} SELECT row_id, input, output, category FROM qa_conv")
def append_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Append one category, then everything, then everything again: each row once."""
    path = scratch_path(spark, "appended")
    rows = a.qa_conv(spark, sf_dir)
    writers.append_jsonl(rows.where(F.col("category") == "c0"), path, "row_id")
    writers.append_jsonl(rows, path, "row_id")
    writers.append_jsonl(rows, path, "row_id")
    return spark.read.schema(rows.schema).json(path)


@query(
    "scan_passages",
    f"""WITH {a.PASSAGES}
    SELECT row_number() OVER (ORDER BY doc_id) - 1 AS doc_id,
           '{PASSAGE_HEADER}: ' || page_content AS page_content
    FROM passages""",
)
def scan_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "passages")
    rows = reshape.format_passage(a.qa_docs(spark, sf_dir)).orderBy("doc_id")
    writers.write_passages(rows, path)
    return readers.scan_passages(spark, path)


@query(
    "write_passages", f"WITH {a.PASSAGES} SELECT page_content AS \"{PASSAGE_HEADER}\" FROM passages"
)
def write_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "passages")
    writers.write_passages(reshape.format_passage(a.qa_docs(spark, sf_dir)), path)
    return readers.scan_passages(spark, path, header_prefix=False).select(
        F.col("page_content").alias(PASSAGE_HEADER)
    )


@query("scan_training_set", f"WITH {a.QA_CONV} SELECT row_id, input, output, category FROM qa_conv")
def scan_training_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "training")
    a.qa_conv(spark, sf_dir).write.parquet(path)
    return readers.scan_training_set(spark, path)


_VECTORS = f"""WITH {a.PASSAGES}
SELECT p.doc_id, p.page_content, e.slot - 1 AS component,
       CAST(v.embedding[e.slot] AS DOUBLE) AS value
FROM embeddings v JOIN passages p ON p.doc_id = v.vec_id
JOIN (SELECT unnest(range(1, {a.COMPONENTS + 1})) AS slot) e ON true"""


@query("write_vectors", _VECTORS)
def write_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "vectors")
    rows = a.passages(spark, sf_dir).join(a.vectors(spark, sf_dir), "doc_id")
    writers.write_vectors(rows, path)
    return readers.scan_vectors(spark, path).select(
        "doc_id", "page_content", F.posexplode("embedding").alias("component", "value")
    ).withColumns({"component": F.col("component").cast("long"), "value": F.col("value").cast("double")})


@query(
    "scan_vectors",
    _VECTORS,
)
def scan_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "vectors")
    # Written beside the library, so that this reads what another tool has left.
    rows = a.passages(spark, sf_dir).join(a.vectors(spark, sf_dir), "doc_id")
    rows.select("doc_id", "page_content", "embedding").write.parquet(path)
    return readers.scan_vectors(spark, path).select(
        "doc_id", "page_content", F.posexplode("embedding").alias("component", "value")
    ).withColumns({"component": F.col("component").cast("long"), "value": F.col("value").cast("double")})


@query("write_submission", f"WITH {a.TEMPLATE} SELECT * EXCLUDE (row_id) FROM template")
def write_submission(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "submission")
    writers.write_submission(a.template(spark, sf_dir), path)
    return readers.scan_template(spark, path).drop("row_id")
