"""Draws within and across categories, and folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from qaloom.catalog import adapters as a
from qaloom.catalog.registry import query
from qaloom.functions.hashing import hash_draw, stable_hash
from qaloom.operators import pairing, split, stats
from qaloom.operators.dense import StoredIndex, range_index

SEED = "7"


def sql_pool(source: str, seed: str, name: str = "pool", skip_first: bool = True) -> str:
    """Rows of each category in hash order, without the first one."""
    where = "WHERE row_id <> first_id" if skip_first else ""
    return f"""{name} AS (
  SELECT *, row_number() OVER (PARTITION BY category ORDER BY {a.sql_hash("row_id", seed)}, row_id) - 1 AS idx,
         count(*) OVER (PARTITION BY category) AS pool_n
  FROM (SELECT *, min(row_id) OVER (PARTITION BY category) AS first_id FROM {source}) {where})"""


@query(
    "stable_hash",
    f"""SELECT doc_id, {a.sql_hash("doc_id", SEED)} AS digest,
      {a.sql_draw(a.sql_hash("doc_id", SEED), "n_chars")} AS draw FROM documents""",
)
def stable_hash_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = stable_hash(F.col("doc_id"), SEED)
    return a.table(spark, sf_dir, "documents").select(
        "doc_id", digest.alias("digest"), hash_draw(digest, F.col("n_chars")).alias("draw")
    )


@query(
    "dense_index",
    f"WITH {a.QA_CONV} SELECT *, row_number() OVER (ORDER BY row_id) - 1 AS position FROM qa_conv",
)
def dense_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return range_index(a.qa_conv(spark, sf_dir), "row_id")


@query(
    "category_pool",
    f"WITH {a.QA_DOCS}, {sql_pool('qa_docs', SEED)} SELECT category, row_id, idx, pool_n FROM pool",
)
def category_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.category_pool(a.qa_docs(spark, sf_dir), SEED)


def sql_partner(source: str, repeats: int) -> str:
    drawn = a.sql_draw(a.sql_hash("q.row_id || '|' || r.draw_no", f"{SEED}|partner"), "n.pool_n")
    return f"""{sql_pool(source, SEED)},
sizes AS (SELECT DISTINCT category, pool_n FROM pool),
draws AS (
  SELECT q.*, r.draw_no, {drawn} AS draw
  FROM {source} q JOIN sizes n USING (category)
  JOIN (SELECT unnest(range(1, {repeats + 1})) AS draw_no) r ON true),
partners AS (
  SELECT d.row_id, d.draw_no, p.row_id AS partner_id, d.input AS q1, d.output AS a1,
         p.input AS q2, p.output AS a2, d.category
  FROM draws d JOIN pool p ON p.category = d.category AND p.idx = d.draw)"""


_PARTNER_OUT = """SELECT row_id, CAST(draw_no AS INTEGER) AS draw_no, partner_id, q1, a1, q2, a2, category
FROM partners"""


@query("category_partner", f"WITH {a.QA_DOCS}, {sql_partner('qa_docs', 1)} {_PARTNER_OUT}")
def category_partner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairing.category_partner(a.qa_docs(spark, sf_dir), SEED)


_WIDE_PAIRED = f"""{a.WIDE_QA},
paired AS (SELECT row_id, q2 AS input, a3 AS output, category FROM wide_qa)"""


@query("category_partner_wide", f"WITH {_WIDE_PAIRED}, {sql_partner('paired', 1)} {_PARTNER_OUT}")
def category_partner_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question 2 with answer 3 of the wide table, on both sides."""
    return pairing.category_partner(a.wide_qa(spark, sf_dir), SEED, question="q2", answer="a3")


@query("category_partner_indexed", f"WITH {a.QA_DOCS}, {sql_partner('qa_docs', 1)} {_PARTNER_OUT}")
def category_partner_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same partners through an index that is laid out once for all who draw."""
    rows = a.qa_docs(spark, sf_dir)
    index = StoredIndex(rows, "category", "row_id", SEED, skip_first=True)
    return pairing.category_partner(rows, SEED, index=index)


@query(
    "minority_partner",
    f"""WITH {a.QA_DOCS}, minor AS (SELECT * FROM qa_docs WHERE category IN ('de', 'es')),
    {sql_partner('minor', 3)} {_PARTNER_OUT}""",
)
def minority_partner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairing.minority_partner(a.qa_docs(spark, sf_dir), SEED, a.MINOR_LANGS, repeats=3)


@query(
    "category_sample_two",
    f"""WITH {a.QA_DOCS}, ranked AS (
      SELECT *, row_number() OVER (
        PARTITION BY category ORDER BY {a.sql_hash("row_id", f"{SEED}|sample")}, row_id) AS r
      FROM (SELECT *, min(row_id) OVER (PARTITION BY category) AS first_id FROM qa_docs)
      WHERE row_id <> first_id)
    SELECT o.category, o.row_id AS row_id_1, o.input AS q1, o.output AS a1,
           t.row_id AS row_id_2, t.input AS q2, t.output AS a2
    FROM ranked o JOIN ranked t ON t.category = o.category AND o.r = 1 AND t.r = 2""",
)
def category_sample_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairing.category_sample_two(a.qa_docs(spark, sf_dir), SEED)


def _sql_side(side: str) -> str:
    drawn = a.sql_draw(a.sql_hash("d.draw_id", f"{SEED}|{side} row"), "s.pool_n")
    return f"""{side}_rows AS (
  SELECT d.draw_id, p.* FROM picks d
  JOIN (SELECT DISTINCT category, pool_n FROM pool) s ON s.category = d.{side}_category
  JOIN pool p ON p.category = d.{side}_category AND p.idx = {drawn})"""


_LISTED = "['" + "', '".join(a.LANGS) + "']"
_DRAWS = f"""draws AS (SELECT unnest(range(500)) AS draw_id),
drawn AS (
  SELECT draw_id, {a.sql_draw(a.sql_hash("draw_id", f"{SEED}|input category"), "4")} AS c1,
         {a.sql_draw(a.sql_hash("draw_id", f"{SEED}|output category"), "3")} AS c2
  FROM draws),
picks AS (
  SELECT draw_id, {_LISTED}[c1 + 1] AS input_category,
         {_LISTED}[c2 + CAST(c2 >= c1 AS INTEGER) + 1] AS output_category
  FROM drawn)"""


@query(
    "negative_pairs",
    f"""WITH {a.QA_DOCS}, {sql_pool('qa_docs', SEED, skip_first=False)}, {_DRAWS},
    {_sql_side("input")}, {_sql_side("output")}
    SELECT i.draw_id, i.row_id AS input_row, o.row_id AS output_row, i.category AS input_category,
           o.category AS output_category, i.input, o.output, '부정라벨링' AS category,
           2.0::DOUBLE AS average_score
    FROM input_rows i JOIN output_rows o USING (draw_id)""",
)
def negative_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairing.negative_pairs(a.qa_docs(spark, sf_dir), SEED, a.LANGS)


def sql_folds(source: str) -> str:
    return f"""ordered AS (
  SELECT *, row_number() OVER (
    ORDER BY first_id, {a.sql_hash("row_id", f"{SEED}|fold")}, row_id) - 1 AS position
  FROM (SELECT *, min(row_id) OVER (PARTITION BY category) AS first_id FROM {source})),
folds AS (
  SELECT * EXCLUDE (first_id, position), CAST(position % 20 AS INTEGER) AS fold,
         position % 20 = 0 AS is_eval
  FROM ordered)"""


@query("stratified_folds", f"WITH {a.QA_DOCS}, {sql_folds('qa_docs')} SELECT * FROM folds")
def stratified_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.stratified_folds(a.qa_docs(spark, sf_dir), SEED)


@query(
    "train_eval_split",
    f"""WITH {a.QA_CONV}, {sql_folds('qa_conv')}
    SELECT CASE WHEN is_eval THEN 'eval' ELSE 'train' END AS side, row_id, input, output, category
    FROM folds""",
)
def train_eval_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, held_out = split.train_eval_split(
        split.stratified_folds(a.qa_conv(spark, sf_dir), SEED)
    )
    sides = [
        side.select(F.lit(name).alias("side"), "row_id", "input", "output", "category")
        for name, side in (("train", train), ("eval", held_out))
    ]
    return sides[0].unionByName(sides[1])
