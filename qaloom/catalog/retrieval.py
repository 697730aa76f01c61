"""Nearest passages, contexts, submission table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from qaloom.catalog import adapters as a
from qaloom.catalog import standins
from qaloom.catalog.registry import query
from qaloom.operators import retrieval
from qaloom.operators.dense import range_index
from qaloom.operators.generation import embed_text, spread
from qaloom.operators.submission import positional_fallback_join
from qaloom.plans.answering import build_submission

_PAIR_DISTANCE = (
    "list_distance(CAST(q.embedding AS DOUBLE[]), CAST(p.embedding AS DOUBLE[])) ** 2"
)
HITS = f"""distances AS (
  SELECT q.vec_id AS id, p.vec_id AS doc_id, {_PAIR_DISTANCE} AS distance
  FROM embeddings q, embeddings p),
hits AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, doc_id) AS rank FROM distances)
  WHERE rank <= 4)"""
_HITS_OUT = f"""WITH {HITS}
SELECT id, CAST(rank AS INTEGER) AS rank, doc_id, round(distance, 6) AS distance FROM hits"""


def _rounded(hits: DataFrame) -> DataFrame:
    return hits.withColumn("distance", F.round("distance", 6))


@query("knn_join", _HITS_OUT)
def knn_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(
        retrieval.knn_join(a.vector_queries(spark, sf_dir), a.vectors(spark, sf_dir))
    )


@query("knn_join_blocked", _HITS_OUT)
def knn_join_blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(
        retrieval.knn_join_blocked(a.vector_queries(spark, sf_dir), a.vectors(spark, sf_dir))
    )


@query("knn_join_pruned", _HITS_OUT)
def knn_join_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(
        retrieval.knn_join_pruned(a.vector_queries(spark, sf_dir), a.vectors(spark, sf_dir))
    )


@query(
    "knn_join_approx",
    f"""WITH {HITS}
    SELECT id, CAST(rank AS INTEGER) AS rank, doc_id, round(distance, 6) AS distance, 1.0::DOUBLE AS recall FROM hits""",
)
def knn_join_approx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits from compressed vectors, and each question's recall against ``knn_join``."""
    asked, stored = a.vector_queries(spark, sf_dir), a.vectors(spark, sf_dir)
    found = retrieval.knn_join_approx(asked, stored)
    recall = retrieval.recall_of(found, retrieval.knn_join(asked, stored))
    return _rounded(found).join(recall, "id")


@query(
    "join_context",
    f"""WITH {a.PASSAGES}, {HITS}
    SELECT h.id, string_agg(p.page_content, chr(10) || chr(10) ORDER BY h.rank) AS context
    FROM hits h JOIN passages p USING (doc_id) GROUP BY h.id""",
)
def join_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = retrieval.knn_join(a.vector_queries(spark, sf_dir), a.vectors(spark, sf_dir))
    return retrieval.join_context(hits, a.passages(spark, sf_dir))


@query(
    "top_k",
    f"""WITH {HITS} SELECT id, CAST(rank AS INTEGER) AS rank, doc_id FROM hits""",
)
def top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.knn_join(
        a.vector_queries(spark, sf_dir), a.vectors(spark, sf_dir), k=4
    ).select("id", "rank", "doc_id")


@query(
    "embed_text",
    f"""WITH {standins.sql_embed("documents", "doc_id", "text", "embedded")}
    SELECT doc_id, slot, value FROM embedded""",
)
def embed_text_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(a.table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])
    return embed_text(docs, "text", standins.embed).select(
        "doc_id", F.posexplode("embedding").alias("slot", "value")
    ).withColumns({"slot": F.col("slot").cast("long"), "value": F.col("value").cast("double")})


_OUTPUTS = """outputs AS (
  SELECT vec_id AS row_id, CASE WHEN label <> 9 THEN embedding END AS embedding FROM embeddings)"""
_FALLBACK = ", ".join(
    f"coalesce(CAST(o.embedding[{i + 1}] AS DOUBLE), t.c{i}) AS c{i}" for i in range(a.COMPONENTS)
)


def _outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors in order; those of one label failed."""
    return a.table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("row_id"),
        F.when(F.col("label") != 9, F.col("embedding")).alias("embedding"),
    )


@query(
    "positional_fallback_join",
    f"""WITH {a.TEMPLATE}, {_OUTPUTS}
    SELECT t.row_id, t.id, {_FALLBACK} FROM template t LEFT JOIN outputs o USING (row_id)""",
)
def positional_fallback_join_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positional_fallback_join(a.template(spark, sf_dir), _outputs(spark, sf_dir))


@query(
    "keyed_fallback_join",
    f"""WITH {a.TEMPLATE}, {_OUTPUTS}, keyed AS (SELECT 'T' || row_id AS id, embedding FROM outputs)
    SELECT t.row_id, t.id, {_FALLBACK} FROM template t LEFT JOIN keyed o USING (id)""",
)
def keyed_fallback_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    outputs = _outputs(spark, sf_dir).select(
        F.concat(F.lit("T"), F.col("row_id").cast("string")).alias("id"), "embedding"
    )
    return positional_fallback_join(a.template(spark, sf_dir), outputs, by="id")


_WIDE = ", ".join(
    f"coalesce(max(CASE WHEN e.slot = {i} THEN e.value END), max(t.c{i})) AS c{i}"
    for i in range(standins.VECTOR_SIZE)
)


@query(
    "build_submission",
    f"""WITH {a.TEMPLATE},
    outputs AS (
      SELECT row_number() OVER (ORDER BY item_id) - 1 AS row_id, text FROM benchmark),
    {standins.sql_embed("outputs", "row_id", "text", "e")}
    SELECT t.row_id, t.id, {_WIDE}
    FROM template t LEFT JOIN e USING (row_id) GROUP BY t.row_id, t.id""",
)
def build_submission_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = range_index(a.table(spark, sf_dir, "benchmark"), "item_id")
    outputs = items.select(F.col("position").alias("row_id"), F.col("text").alias("output"))
    return build_submission(outputs, a.template(spark, sf_dir), standins.embed)
