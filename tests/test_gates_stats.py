from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from qaloom.operators import gates, stats


def records(spark, lengths):
    return spark.createDataFrame(
        [(i, "가" * n, "c") for i, n in enumerate(lengths)],
        "row_id long, output string, category string",
    )


@pytest.mark.parametrize(
    "lengths",
    [
        list(range(1, 11)),
        list(range(1, 12)),
        [5] * 4 + [9] * 12 + [20] * 4,
        [7],
        [3, 3, 3, 3],
        [1, 1, 2, 50, 50, 50, 51, 52, 53, 54, 55, 55, 90, 90, 90, 91, 92, 92, 92, 93],
    ],
)
def test_quantiles_and_band(spark, lengths):
    df = records(spark, lengths)
    ordered = sorted(lengths)
    n = len(ordered)
    expected = {"median": n // 2, "p90": int(n * 0.90), "p5": int(n * 0.05)}
    got = stats.length_stats(df).first()
    assert {k: got[k] for k in expected} == {k: ordered[i] for k, i in expected.items()}
    assert (got["n"], got["max_length"], got["min_length"]) == (n, ordered[-1], ordered[0])
    assert got["mean_length"] == pytest.approx(sum(lengths) / n)

    low, high = ordered[int(n * 0.05)], ordered[int(n * 0.90)]
    kept = sorted(r[0] for r in gates.length_quantile_band(df).select(F.length("output")).collect())
    assert kept == [v for v in ordered if low < v < high]


def test_band_of_nothing(spark):
    assert gates.length_quantile_band(records(spark, [])).count() == 0


def test_markers_are_literal(spark):
    texts = ["plain", "**bold**", "one * star", "a-b", "책임소재 있음", "full－width", "a.*b", "—"]
    df = spark.createDataFrame([(t,) for t in texts], "output string")
    kept = {r[0] for r in gates.drop_marked(df).collect()}
    assert kept == {"plain", "one * star", "full－width", "a.*b", "—"}
    assert gates.drop_marked(df, [".*"]).count() == len(texts) - 1
    assert gates.drop_marked(gates.drop_marked(df)).count() == len(kept)


def test_length_range(spark):
    df = records(spark, [99, 100, 300, 301])
    assert sorted(r[0] for r in gates.length_range(df).select("row_id").collect()) == [1, 2]
    signs = spark.createDataFrame([("😀" * 100,), ("é" * 50,), ("é" * 49,)], "output string")
    assert gates.length_range(signs).count() == 2


def test_score_gate_and_counts(spark):
    df = spark.createDataFrame(
        [("3.00", "a"), ("2.67", "a"), ("2", "b"), ("4.33", "b"), ("bad", "b"), (None, "b")],
        "average_score string, category string",
    )
    assert {r[0] for r in gates.score_gate(df).select("average_score").collect()} == {"3.00", "4.33"}
    assert stats.below_threshold_count(df).first()["n"] == 2
    assert stats.mean_score(df).first()[0] == pytest.approx((3 + 2.67 + 2 + 4.33) / 4)
    histogram = {r["average_score"]: r["n"] for r in stats.score_histogram(df).collect()}
    assert histogram["2.00"] == 1 and histogram["3.00"] == 1


def test_foreign_scripts(spark):
    df = spark.createDataFrame(
        [("한국어만",), ("도배지が剥がれた",), ("방음은 soundproofing 이다",)], "output string"
    )
    # Neither Japanese nor English by default; one of them on request.
    assert gates.foreign_script_filter(df).count() == 1
    assert gates.foreign_script_filter(df, ["kana"]).count() == 2
    kept = gates.foreign_script_filter(df, ["latin"], max_share=0.5).count()
    assert kept == 2


def test_category_shares(spark):
    df = spark.createDataFrame([("a",)] * 3 + [("b",)], "category string")
    got = {r["category"]: (r["n"], r["pct"]) for r in stats.category_shares(df).collect()}
    assert got == {"a": (3, 75.0), "b": (1, 25.0)}
    assert stats.minority_total(df, ["b"]).first()["n"] == 1


def test_report_of_nothing(spark):
    empty = spark.createDataFrame([], "category string, output string, average_score double")
    report = {r["metric"]: r["value"] for r in stats.dataset_report(empty).collect()}
    assert report["mean_length"] is None


def test_resume_pending(spark, qa):
    done = qa.where("row_id < 100")
    assert gates.resume_pending(qa, done).count() == 21
