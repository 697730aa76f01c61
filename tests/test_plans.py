"""Shapes the physical plans must keep."""

from __future__ import annotations

import re

import pytest

from qaloom.catalog import QUERIES
from qaloom.catalog import adapters
from qaloom.functions.batch import generated
from qaloom.operators import pairing, prompts, retrieval
from qaloom.operators.dense import RankDirectory
from qaloom.operators.stats import category_pool
from qaloom.plans import augment
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize(
    "name",
    [
        "category_partner", "minority_partner", "category_sample_two", "negative_pairs",
        "stratified_folds", "length_quantile_band", "category_shares", "dataset_report",
        "knn_join", "knn_join_blocked", "knn_join_pruned", "join_context",
        "positional_fallback_join", "resume_pending",
    ],
)
def test_no_nested_loops(spark, name, no_broadcast):
    plan = plan_of(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_large_side_moves_once_for_folds(spark, no_broadcast):
    """The window and the join with the bucket offsets share one exchange of the rows."""
    plan = plan_of(QUERIES["stratified_folds"](spark, SF))
    with_text = [line for line in plan.splitlines() if "FileScan" in line and ",text#" in line]
    assert len(with_text) == 1
    window_to_scan = plan[plan.index("row_number()") :]
    window_to_scan = window_to_scan[: window_to_scan.index("FileScan")]
    above_window = plan[: plan.index("row_number()")]
    assert window_to_scan.count("Exchange") == 1 and "Exchange" not in above_window


def test_partner_index_reads_ids_only(spark):
    rows = adapters.qa_docs(spark, SF)
    plan = plan_of(pairing.category_partner(rows, 1))
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    narrow = [s for s in schemas if "text" not in s]
    assert len(schemas) - len(narrow) == 2


def test_category_filter_reaches_the_scan(spark):
    plan = plan_of(QUERIES["category_in"](spark, SF))
    assert "PushedFilters: [In(lang, [de,es])]" in plan


def test_top_k_is_partial_and_final(spark):
    plan = plan_of(
        retrieval.knn_join_blocked(
            adapters.vector_queries(spark, SF), adapters.vectors(spark, SF)
        )
    )
    assert plan.count("WindowGroupLimit") == 2


def test_only_prompt_and_key_cross_to_python(spark):
    rows = adapters.qa_docs(spark, SF).withColumn("unused", F.lit("x"))
    asked = prompts.build_rubric_prompt(rows, ["row_id"])
    answered = asked.select("row_id", generated(F.col("prompt"), lambda t, a: t, bool, 1))
    plan = plan_of(answered)
    assert "ArrowEvalPython" in plan
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_length_band_filters_in_one_pass(spark):
    plan = plan_of(QUERIES["length_quantile_band"](spark, SF))
    assert "Join" not in plan.replace("ReusedSubquery", "")


def test_embedding_is_computed_once(spark):
    plan = plan_of(QUERIES["embed_text"](spark, SF))
    assert plan.count("ArrowEvalPython") == 1


def test_rounds_fetch_only_what_a_draw_can_fall_on(spark):
    """The directory holds no text, and a window's folder holds the drawn places only."""
    rows = adapters.qa_docs(spark, SF)
    directory = RankDirectory(rows, "category", "row_id", 1, skip_first=True)
    scans = [line for line in plan_of(directory.rows).splitlines() if "ReadSchema" in line]
    assert scans and not any("text" in line for line in scans)
    held = {r["category"]: r["pool_n"] for r in directory.sizes().collect()}
    texts = "category string, idx long, input string, output string"
    folder = augment._window(rows, directory, held, held, 1, 0, 4, texts)
    found = spark.read.parquet(folder)
    assert 0 < found.count() <= 2 * len(held) * (1 + 2 + 3 + 4)
    pool = {(r.category, r.idx): r.row_id for r in category_pool(rows, 1).collect()}
    by_id = {r.row_id: (r.input, r.output) for r in rows.collect()}
    assert all(by_id[pool[r.category, r.idx]] == (r.input, r.output) for r in found.collect())


def test_only_drawn_buckets_are_ranked(spark):
    """Below the window that ranks, ids are cut to the buckets of the draws."""
    rows = adapters.qa_docs(spark, SF)
    directory = RankDirectory(rows, "category", "row_id", 1)
    asked = spark.createDataFrame([("en", 0), ("en", 7), ("fr", 3)], "category string, idx long")
    plan = plan_of(directory.locate(asked))
    ranking = plan[plan.index("row_number()") :]
    ranking = ranking[: ranking.index("text") if "text" in ranking else len(ranking)]
    assert ranking.index("Join") < ranking.index("documents")
    assert all("text" not in s for s in re.findall(r"ReadSchema: struct<([^>]*)>", plan))


def test_hot_key_is_spread_over_buckets(spark, no_broadcast):
    """One key with all rows: no task of the window gets more than a small part of them."""
    rows = spark.range(40_000).selectExpr("id AS row_id", "'hot' AS category")
    indexed = pairing.hash_index(rows, "category", "row_id", 1)
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = [
            r["n"]
            for r in indexed.select("idx", F.spark_partition_id().alias("task"))
            .groupBy("task")
            .agg(F.count("idx").alias("n"), F.max("idx"))
            .collect()
        ]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert len(sizes) == 4 and max(sizes) < 12_000
