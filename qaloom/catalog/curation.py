"""Gates and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from qaloom.catalog import adapters as a
from qaloom.catalog.registry import query
from qaloom.operators import gates, stats

BAND = """lengths AS (
  SELECT length(output) AS v, row_number() OVER (ORDER BY length(output)) - 1 AS i, count(*) OVER () AS n
  FROM qa_docs),
band AS (
  SELECT min(v) FILTER (i = CAST(floor(n * 0.05) AS BIGINT)) AS lo,
         min(v) FILTER (i = CAST(floor(n * 0.90) AS BIGINT)) AS hi
  FROM lengths),
banded AS (
  SELECT q.* FROM qa_docs q JOIN band ON length(q.output) > lo AND length(q.output) < hi)"""

UNMARKED = (
    "NOT contains(output, '**') AND NOT contains(output, '책임소재') AND NOT contains(output, '-')"
)


@query("length_quantile_band", f"WITH {a.QA_DOCS}, {BAND} SELECT * FROM banded")
def length_quantile_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.length_quantile_band(a.qa_docs(spark, sf_dir))


@query("drop_marked", f"WITH {a.QA_DOCS} SELECT * FROM qa_docs WHERE {UNMARKED}")
def drop_marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.drop_marked(a.qa_docs(spark, sf_dir))


@query("length_range", f"WITH {a.QA_DOCS} SELECT * FROM qa_docs WHERE length(output) BETWEEN 100 AND 300")
def length_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.length_range(a.qa_docs(spark, sf_dir))


@query(
    "score_gate",
    f"""WITH {a.SCORED_DOCS} SELECT row_id, category, output, round(average_score, 6) AS average_score
    FROM scored_docs WHERE average_score >= 3""",
)
def score_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.score_gate(a.scored_docs(spark, sf_dir)).withColumn(
        "average_score", F.round("average_score", 6)
    )


@query("category_in", f"WITH {a.QA_DOCS} SELECT * FROM qa_docs WHERE category IN ('de', 'es')")
def category_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.category_in(a.qa_docs(spark, sf_dir), a.MINOR_LANGS)


@query(
    "drop_unknown_category",
    f"WITH {a.QA_CONV} SELECT * FROM qa_conv WHERE category IN ('c0', 'c1', 'c2', 'c3', 'c4')",
)
def drop_unknown_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.drop_unknown_category(
        a.qa_conv(spark, sf_dir), ["c0", "c1", "c2", "c3", "c4"]
    )


@query(
    "foreign_script_filter",
    f"""WITH {a.QA_DOCS} SELECT * FROM qa_docs
    WHERE coalesce(len(regexp_extract_all(output, '[À-ɏ]|[぀-ヿ]'))::DOUBLE / nullif(length(output), 0), 0) <= 0.01""",
)
def foreign_script_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.foreign_script_filter(
        a.qa_docs(spark, sf_dir), ["latin_accented", "kana"], max_share=0.01
    )


@query(
    "resume_pending",
    f"""WITH {a.QA_DOCS} SELECT * FROM qa_docs
    WHERE row_id NOT IN (SELECT doc_id FROM labels)""",
)
def resume_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = a.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("row_id"))
    return gates.resume_pending(a.qa_docs(spark, sf_dir), done)


@query("row_count", f"WITH {a.QA_CONV} SELECT count(*) AS n FROM qa_conv")
def row_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.row_count(a.qa_conv(spark, sf_dir))


@query("category_counts", f"WITH {a.QA_DOCS} SELECT category, count(*) AS n FROM qa_docs GROUP BY category")
def category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.category_counts(a.qa_docs(spark, sf_dir))


SHARES = """SELECT category, count(*) AS n,
  round(count(*)::DOUBLE / (SELECT count(*) FROM {table}) * 100, 2) AS pct
FROM {table} GROUP BY category"""


@query("category_shares", f"WITH {a.QA_DOCS} {SHARES.format(table='qa_docs')}")
def category_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.category_shares(a.qa_docs(spark, sf_dir))


@query(
    "minority_total",
    f"WITH {a.QA_DOCS} SELECT count(*) FILTER (category IN ('de', 'es')) AS n FROM qa_docs",
)
def minority_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.minority_total(a.qa_docs(spark, sf_dir), a.MINOR_LANGS)


@query(
    "index_quantile",
    f"""WITH {a.QA_DOCS}, s AS (
      SELECT length(output) AS v, row_number() OVER (ORDER BY length(output)) - 1 AS i,
             count(*) OVER () AS n
      FROM qa_docs)
    SELECT min(v) FILTER (i = CAST(floor(n * 0.25) AS BIGINT)) AS p25,
           min(v) FILTER (i = CAST(floor(n * 0.75) AS BIGINT)) AS p75,
           min(v) FILTER (i = CAST(floor(n * 0.99) AS BIGINT)) AS p99
    FROM s""",
)
def index_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = a.qa_docs(spark, sf_dir).select(F.length("output").alias("v")).withColumn(
        "v", F.col("v").cast("long")
    )
    return stats.index_quantile(lengths, "v", {"p25": 0.25, "p75": 0.75, "p99": 0.99})


@query(
    "length_stats",
    f"""WITH {a.QA_DOCS}, s AS (
      SELECT length(output) AS v, row_number() OVER (ORDER BY length(output)) - 1 AS i,
             count(*) OVER () AS c
      FROM qa_docs)
    SELECT count(*) AS n, round(avg(v), 6) AS mean_length, max(v) AS max_length, min(v) AS min_length,
           min(v) FILTER (i = c // 2) AS median,
           min(v) FILTER (i = CAST(floor(c * 0.90) AS BIGINT)) AS p90,
           min(v) FILTER (i = CAST(floor(c * 0.05) AS BIGINT)) AS p5
    FROM s""",
)
def length_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = stats.length_stats(a.qa_docs(spark, sf_dir))
    whole = {c: F.col(c).cast("long") for c in ("max_length", "min_length", "median", "p90", "p5")}
    return one.withColumns({**whole, "mean_length": F.round("mean_length", 6)})


@query(
    "score_histogram",
    f"""WITH {a.SCORED_DOCS}, some_missing AS (SELECT nullif(average_score, 3.0) AS s FROM scored_docs)
    SELECT CASE WHEN s IS NOT NULL THEN printf('%.2f', s) END AS average_score, count(*) AS n
    FROM some_missing GROUP BY 1""",
)
def score_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = a.scored_docs(spark, sf_dir)
    return stats.score_histogram(rows.withColumn("average_score", F.nullif("average_score", F.lit(3.0))))


@query(
    "below_threshold_count",
    f"WITH {a.SCORED_DOCS} SELECT count(*) FILTER (average_score < 3) AS n FROM scored_docs",
)
def below_threshold_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.below_threshold_count(a.scored_docs(spark, sf_dir))


@query(
    "mean_score",
    f"WITH {a.SCORED_DOCS} SELECT round(avg(average_score), 6) AS mean_score FROM scored_docs",
)
def mean_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.mean_score(a.scored_docs(spark, sf_dir)).select(
        F.round("mean_score", 6).alias("mean_score")
    )


REPORT = """totals AS (
  SELECT count(*)::DOUBLE AS n, avg(length(output)) AS mean_length, max(length(output))::DOUBLE AS longest,
         min(length(output))::DOUBLE AS shortest, avg(average_score) AS mean_score
  FROM {table}),
report AS (
  SELECT 'count' AS metric, '' AS category, n AS value FROM totals
  UNION ALL SELECT 'mean_length', '', mean_length FROM totals
  UNION ALL SELECT 'max_length', '', longest FROM totals
  UNION ALL SELECT 'min_length', '', shortest FROM totals
  UNION ALL SELECT 'mean_score', '', mean_score FROM totals
  UNION ALL SELECT 'share', category, round(count(*)::DOUBLE / (SELECT n FROM totals) * 100, 2)
  FROM {table} GROUP BY category)
SELECT metric, category, round(value, 6) AS value FROM report"""


@query("dataset_report", f"WITH {a.SCORED_DOCS}, {REPORT.format(table='scored_docs')}")
def dataset_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.dataset_report(a.scored_docs(spark, sf_dir)).withColumn(
        "value", F.round("value", 6)
    )
