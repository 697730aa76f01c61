"""The quality gates as a restartable stream over a folder of JSON-line files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from qaloom.functions.text import format_score
from qaloom.operators import gates, responses
from qaloom.schemas import DEFAULT_SCORE, MAX_LENGTH, MIN_LENGTH, MIN_SCORE

# How long the id of a row that passed is kept.
REMEMBER = "30 days"
SOURCE_SCHEMA = "row_id long, category string, pair_response string, score_response string"


def gate_responses(
    rows: DataFrame,
    markers: list[str] | None = None,
    low: int = MIN_LENGTH,
    high: int = MAX_LENGTH,
    minimum: float = MIN_SCORE,
    default: float = DEFAULT_SCORE,
) -> DataFrame:
    """Parse pair and score responses and keep the rows that pass every fixed gate.

    Works on a batch and on a stream alike: each row is decided by itself. Thresholds
    that depend on the whole table (a quantile band) have no place here.
    """
    pair = responses.parse_qa_pair(F.col("pair_response"))
    marks = responses.parse_rubric(F.col("score_response"))
    parsed = (
        rows.select("row_id", "category", pair.alias("pair"), marks.alias("marks"))
        .where("pair.ok")
        .select(
            "row_id",
            "category",
            F.col("pair.input").alias("input"),
            F.col("pair.output").alias("output"),
            F.coalesce(F.col("marks.average"), F.lit(default)).alias("average_score"),
        )
    )
    kept = gates.drop_marked(gates.length_range(parsed, low, high), markers)
    return gates.score_gate(kept, minimum)


def once(passed: DataFrame, remember: str = REMEMBER) -> DataFrame:
    """The first row of every id that a stream of passed rows brings within ``remember``."""
    own = F.concat(F.lit("~"), F.md5(F.to_json(F.struct("input", "output"))))
    keyed = passed.withColumn("_key", F.coalesce(F.col("row_id").cast("string"), own)).withColumn("_seen", F.current_timestamp())
    return keyed.withWatermark("_seen", remember).dropDuplicatesWithinWatermark(["_key"]).drop("_key", "_seen")


def stream_quality_gates(
    spark: SparkSession,
    source: str,
    target: str,
    checkpoint: str,
    max_files_per_trigger: int = 1000,
    remember: str = REMEMBER,
    **options,
) -> StreamingQuery:
    """Take in the files not yet seen, append what passes, and stop.

    The checkpoint remembers the files and the sink its commits, so a restart neither
    repeats nor loses a row. A row that is delivered again, in the same file or a later
    one, passes once: the first delivery that passes the gates counts, and its id is kept
    as state for ``remember``. The watermark is the time of processing, so no row is ever
    late, however old its file. Rows without an id are told apart by their responses.
    """
    rows = (
        spark.readStream.schema(SOURCE_SCHEMA)
        .option("maxFilesPerTrigger", max_files_per_trigger)
        .json(source)
    )
    passed = once(gate_responses(rows, **options), remember).withColumn(
        "average_score", format_score(F.col("average_score"))
    )
    return (
        passed.writeStream.format("json")
        .option("path", target)
        .option("checkpointLocation", checkpoint)
        .option("ignoreNullFields", False)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
