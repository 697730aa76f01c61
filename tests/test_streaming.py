from __future__ import annotations

from pyspark.sql import functions as F

from qaloom.functions.text import format_score
from qaloom.schemas import RUBRIC_MARKERS
from qaloom.streaming.gates import SOURCE_SCHEMA, gate_responses, stream_quality_gates


def incoming(spark, start, stop):
    rows = []
    for i in range(start, stop):
        answer = ("w" * (60 + i * 10)) + ("-" if i % 7 == 0 else "")
        pair = "no pair" if i % 5 == 0 else f"Q: q{i}\nA: {answer}"
        score = "none" if i % 6 == 0 else "".join(f"{m}{i % 6}" for m in RUBRIC_MARKERS)
        rows.append((i, "c", pair, score))
    return spark.createDataFrame(rows, SOURCE_SCHEMA)


def test_stream_equals_batch_and_restarts(spark, tmp_path):
    source, target, checkpoint = (str(tmp_path / n) for n in ("in", "out", "check"))

    def run():
        stream_quality_gates(spark, source, target, checkpoint).awaitTermination()
        return sorted(spark.read.json(target).select("row_id", "average_score", "output").collect())

    def batch(stop):
        rows = gate_responses(incoming(spark, 0, stop))
        return sorted(
            rows.select("row_id", format_score(F.col("average_score")), "output").collect()
        )

    incoming(spark, 0, 20).repartition(3).write.json(source)
    assert run() == batch(20)
    assert run() == batch(20)
    incoming(spark, 20, 35).write.mode("append").json(source)
    assert run() == batch(35)
