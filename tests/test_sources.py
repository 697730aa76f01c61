from __future__ import annotations

import json

from pyspark.sql import functions as F

from qaloom.schemas import AUDITED_RECORD, SCORED_RECORD
from qaloom.sources import readers, writers

HEAD = "id,질문_1,질문_2,category,답변_1,답변_2,답변_3,답변_4,답변_5"


def test_wide_csv(spark, tmp_path):
    path = tmp_path / "train.csv"
    path.write_text(
        HEAD
        + '\nT0,"첫 줄\n둘째 줄","say ""hi""",마감재,"a, b",x2,x3,x4,x5'
        + "\nT1,q1,NA,시공,y1,,y3,nan,  y5 "
        + "\nT2,q,r,기타,1,2,3,4,5\n",
        encoding="utf-8",
    )
    rows = readers.scan_wide_qa(spark, str(path)).orderBy("row_id").collect()
    assert [r["row_id"] for r in rows] == [0, 1, 2]
    assert rows[0]["q1"] == "첫 줄\n둘째 줄"
    assert rows[0]["q2"] == 'say "hi"'
    assert rows[0]["a1"] == "a, b"
    assert rows[1]["q2"] is None and rows[1]["a2"] is None and rows[1]["a4"] is None
    assert rows[1]["a5"] == "  y5 "
    assert rows[2].asDict() == {
        "row_id": 2, "q1": "q", "q2": "r", "a1": "1", "a2": "2", "a3": "3", "a4": "4",
        "a5": "5", "category": "기타",
    }


def test_row_ids_follow_files_and_splits(spark, tmp_path):
    """Positions run through files in name order and through the splits of each file."""
    root = tmp_path / "parts"
    root.mkdir()
    expected = []
    for part in range(3):
        lines = []
        for i in range(400):
            text = f"{part}-{i}-" + "z" * (i % 50)
            lines.append(json.dumps({"input": text, "output": "o", "category": "c"}))
            expected.append(text)
            if i % 100 == 50:
                lines.append("")
        (root / f"part-{part}.json").write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        rows = readers.scan_jsonl(spark, str(root), row_id=True)
        assert rows.rdd.getNumPartitions() > 3
        got = {r["row_id"]: r["input"] for r in rows.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [got[i] for i in range(len(expected))] == expected


def test_scored_jsonl_mixes_text_and_number(spark, tmp_path):
    path = tmp_path / "scored.jsonl"
    path.write_text(
        '{"input": "가", "output": "나", "category": "c", "average_score": "4.33"}\n'
        '{"input": "q", "output": NaN, "category": "c", "average_score": 2}\n'
        '{"input": "q", "category": "c"}\n',
        encoding="utf-8",
    )
    rows = readers.scan_scored_jsonl(spark, str(path), row_id=True).orderBy("row_id").collect()
    assert [r["average_score"] for r in rows] == [4.33, 2.0, None]
    assert [r["output"] for r in rows] == ["나", None, None]
    raw = readers.scan_jsonl(spark, str(path), SCORED_RECORD)
    assert {r["average_score"] for r in raw.collect()} == {"4.33", "2", None}


def test_jsonl_writer(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.createDataFrame(
        [("가", None, 13 / 3)], "input string, output string, average_score double"
    )
    writers.write_jsonl(df, path)
    lines = [r["value"] for r in spark.read.text(path).collect()]
    assert lines == ['{"input":"가","output":null,"average_score":"4.33"}']


def test_audited_records_round_trip(spark, tmp_path):
    path = str(tmp_path / "audited")
    df = spark.createDataFrame(
        [("a", "b", "c", 3.0, True, "A", "b"), ("a", "b", "c", 3.0, False, "", "")],
        "input string, output string, category string, average_score double, "
        "is_corrected boolean, before_input string, before_output string",
    )
    writers.write_jsonl(df, path)
    rows = readers.scan_jsonl(spark, path, AUDITED_RECORD).collect()
    assert {(r["is_corrected"], r["average_score"]) for r in rows} == {("True", "3.00"), ("False", "3.00")}


def test_append_with_key_runs_once(spark, tmp_path, qa):
    path = str(tmp_path / "out")
    writers.append_jsonl(qa.where("row_id < 10"), path, "row_id")
    writers.append_jsonl(qa, path, "row_id")
    writers.append_jsonl(qa, path, "row_id")
    assert spark.read.json(path).count() == qa.count()
    writers.append_jsonl(qa, path)
    assert spark.read.json(path).count() == 2 * qa.count()


def test_passages_round_trip(spark, tmp_path):
    path = str(tmp_path / "passages")
    df = spark.createDataFrame([("a, \"b\"\nc",)], "passage string")
    writers.write_passages(df, path)
    assert readers.scan_passages(spark, path).first()["page_content"] == '0: a, "b"\nc'
    bare = readers.scan_passages(spark, path, header_prefix=False).first()
    assert (bare["doc_id"], bare["page_content"]) == (0, 'a, "b"\nc')


def test_questions_and_template(spark, tmp_path):
    (tmp_path / "test.csv").write_text("id,질문\nT_0,무엇?\nT_1,왜?\n", encoding="utf-8")
    rows = readers.scan_questions(spark, str(tmp_path / "test.csv")).orderBy("row_id").collect()
    assert [(r["id"], r["question"]) for r in rows] == [("T_0", "무엇?"), ("T_1", "왜?")]
    (tmp_path / "sub.csv").write_text("id,vec_0,vec_1\nT_0,0,0.25\nT_1,1,\n")
    table = readers.scan_template(spark, str(tmp_path / "sub.csv")).orderBy("row_id")
    assert table.columns == ["row_id", "id", "vec_0", "vec_1"]
    assert [tuple(r) for r in table.collect()] == [(0, "T_0", 0.0, 0.25), (1, "T_1", 1.0, None)]


def test_training_set_from_json(spark, tmp_path):
    path = tmp_path / "train.jsonl"
    path.write_text('{"input": "q", "output": "a", "category": "c"}\n')
    got = readers.scan_training_set(spark, str(path), "json").collect()
    assert [r.asDict() for r in got] == [{"row_id": 0, "input": "q", "output": "a", "category": "c"}]


def test_vectors_round_trip(spark, tmp_path):
    path = str(tmp_path / "vectors")
    df = spark.createDataFrame(
        [(1, "t", [0.5, -1.0])], "doc_id long, page_content string, embedding array<float>"
    )
    writers.write_vectors(df.withColumn("extra", F.lit(1)), path)
    assert readers.scan_vectors(spark, path).collect() == df.collect()
