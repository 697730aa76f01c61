"""Exact quantiles of wide columns, a stored index, rows delivered twice, narrow scans."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from qaloom.operators import pairing, stats
from qaloom.operators.dense import RankDirectory, StoredIndex
from qaloom.schemas import RUBRIC_MARKERS
from qaloom.sources.readers import scan_questions, scan_template, scan_wide_qa
from qaloom.streaming.gates import stream_quality_gates

PLACES = {"lo": 0.0, "p5": 0.05, "median": 0.5, "p90": 0.9, "hi": 0.9999}


def exact(values, places):
    ordered = sorted(values)
    return {name: ordered[min(int(len(ordered) * p), len(ordered) - 1)] for name, p in places.items()}


COLUMNS = {
    "every value once": lambda draw, n: [draw.random() * 10 ** draw.randint(-300, 300) for _ in range(n)],
    "two values": lambda draw, n: [float(draw.random() < 0.3) for _ in range(n)],
    "one value": lambda draw, n: [7.0] * n,
    "a third is one value": lambda draw, n: [5.0 if draw.random() < 0.34 else draw.gauss(5, 1) for _ in range(n)],
    "ends are hot": lambda draw, n: [draw.choice([-1e9, 1e9]) if draw.random() < 0.99 else draw.random() for _ in range(n)],
}


@pytest.mark.parametrize("kind", COLUMNS)
def test_quantiles_of_any_column(spark, kind):
    values = COLUMNS[kind](random.Random(1), 30_000)
    df = spark.createDataFrame([(v,) for v in values] + [(None,)] * 5, "v double").repartition(5)
    got = stats.index_quantile(df, "v", PLACES, settled=50).first().asDict()
    assert got == exact(values, PLACES)


def test_quantiles_of_longs_dates_and_nothing(spark):
    values = [(i * 7919) % 100_003 * 10**13 for i in range(20_000)]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    assert stats.index_quantile(df, "v", PLACES, settled=10).first().asDict() == exact(values, PLACES)
    assert stats.index_quantile(df, "v", PLACES).first().asDict() == exact(values, PLACES)
    assert stats.index_quantile(df.limit(0), "v", {"p": 0.5}).first().asDict() == {"p": None}
    assert stats.histogram_quantile(df, "v", {"p": 0.5}).first().p == exact(values, {"p": 0.5})["p"]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_stored_index_is_joined_in_place(spark, qa):
    index = StoredIndex(qa, "category", "row_id", 5, skip_first=True, buckets=4)
    key = ("row_id", "draw_no", "partner_id")
    usual = pairing.category_partner(qa, 5, repeats=2).select(*key)
    stored = pairing.category_partner(qa, 5, repeats=2, index=index).select(*key)
    assert sorted(stored.collect()) == sorted(usual.collect())
    before = {c: spark.conf.get(c) for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        for c, v in zip(before, ("-1", "false")):
            spark.conf.set(c, v)
        links = index.locate(index.rows().where("idx is not null").select("category", F.col("row_id").alias("own"), F.pmod("row_id", "pool_n").alias("idx")))
        plan = plan_of(links)
        # Only the draws are exchanged; the stored side is read bucket by bucket.
        assert plan.count("Exchange hashpartitioning") == 1 and "SelectedBucketsCount: 4 out of 4" in plan
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    spark.sql(f"DROP TABLE {index.name}")


def test_operators_share_one_index(spark, qa):
    index = StoredIndex(qa, "category", "row_id", 2)
    usual = pairing.negative_pairs(qa, 2, ["a", "b", "c"], n=60).collect()
    shared = pairing.negative_pairs(qa, 2, ["a", "b", "c"], n=60, index=index).collect()
    assert sorted(usual) == sorted(shared) and len(usual) == 60
    directory = RankDirectory(qa, "category", "row_id", 2)
    assert sorted(directory.sizes().collect()) == sorted(index.sizes().collect())
    missing = spark.createDataFrame([(1, None), (2, None), (3, "a")], "row_id long, category string")
    rows = StoredIndex(missing, "category", "row_id", 0).rows().collect()
    assert sorted((r.category or "", r.idx) for r in rows) == [("", 0), ("", 1), ("a", 0)]


def delivered(spark, folder, rows):
    score = "".join(f"{m}4" for m in RUBRIC_MARKERS)
    low = "".join(f"{m}1" for m in RUBRIC_MARKERS)
    out = [(i, "c", f"Q: {q}\nA: {'y' * 150}", score if good else low) for i, q, good in rows]
    schema = "row_id long, category string, pair_response string, score_response string"
    spark.createDataFrame(out, schema).coalesce(1).write.mode("append").json(folder)


def test_a_row_in_a_later_file_passes_once(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))

    def run():
        stream_quality_gates(spark, source, target, checkpoint).awaitTermination()
        rows = spark.read.schema("row_id long, input string").json(target).collect()
        return sorted((r.row_id if r.row_id is not None else -1, r.input) for r in rows)

    delivered(spark, source, [(1, "one", True), (2, "two", False), (1, "one", True), (None, "x", True)])
    first = run()
    assert first == [(-1, "x"), (1, "one")]
    # After a restart: 1 and the row without an id come again, 2 comes again and passes now.
    delivered(spark, source, [(1, "one", True), (2, "two", True), (3, "three", True), (None, "x", True), (None, "z", True)])
    assert run() == [(-1, "x"), (-1, "z"), (1, "one"), (2, "two"), (3, "three")]
    assert run() == [(-1, "x"), (-1, "z"), (1, "one"), (2, "two"), (3, "three")]


def test_a_narrow_scan_writes_only_what_is_asked_for(spark, tmp_path, monkeypatch):
    from qaloom.sources import readers

    names = {"A": "q1", "B": "q2", "C": "a1", "D": "category"}
    path = str(tmp_path / "wide.csv")
    spark.createDataFrame([(f"q{i}", "two", "x" * 50, "c") for i in range(20)], "A string, B string, C string, D string").coalesce(1).write.option("header", True).csv(path)
    seen = []
    original = readers.written
    monkeypatch.setattr(readers, "written", lambda df, name, *a: (seen.append(set(df.columns)), original(df, name, *a))[1])
    rows = scan_wide_qa(spark, path, names, columns=["q1"])
    assert sorted(map(tuple, rows.collect())) == sorted((i, f"q{i}") for i in range(20))
    assert seen[0] == {"A", "_file", "_block", "_seen"}
    assert scan_questions(spark, path, {"A": "id", "B": "question"}, columns=["id"]).columns == ["row_id", "id"]
    assert scan_template(spark, path, "A", columns=["C"]).columns == ["row_id", "id", "C"]
    with pytest.raises(ValueError):
        scan_wide_qa(spark, path, names, columns=["a9"])
