"""Generation with retries, and the row-wise functions that need a model."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from qaloom.functions.batch import CALL_SIZE, Correct, Embed, Generate, corrected, embedded, generated
from qaloom.lineage import exists, finished, written
from qaloom.operators.reshape import correction_audit
from qaloom.operators.responses import Parser

# Prompts of one file, and files of one commit: what a killed job may have to ask again.
COMMIT_ROWS, COMMIT_FILES = 1_000, 64


def spread(df: DataFrame, keys: list[str]) -> DataFrame:
    """Move rows apart by key: bytes per split say little about the cost of a model call.

    Only the key and what the call needs should be in ``df``; prompts are built after it.
    """
    return df.repartition(*keys)


class Answers:
    """Prompts to parsed answers: the kept columns, the parser's, ``attempt`` and ``error``.

    Nothing is written here; whoever calls it must run the result in one action. The
    expressions are made once, for callers that ask again and again.
    """

    def __init__(
        self,
        kept: list[str],
        fn: Generate,
        parser: Parser,
        max_attempts: int,
        result_type: str = "string",
        call_size: int = CALL_SIZE,
    ):
        kept_columns = [F.col(c) for c in kept]
        answer = generated(F.col("prompt"), fn, parser.readable, max_attempts, result_type, call_size)
        self.steps = [
            [*kept_columns, answer.alias("_answer")],
            [
                *kept_columns,
                parser.columns(F.col("_answer.response")).alias("_parsed"),
                F.col("_answer.attempt").alias("attempt"),
                F.col("_answer.error").alias("error"),
            ],
            [*kept_columns, F.col("_parsed.*"), F.col("attempt"), F.col("error")],
        ]

    def __call__(self, prompts: DataFrame) -> DataFrame:
        for columns in self.steps:
            prompts = prompts.select(*columns)
        return prompts


class NoUsableResponse(RuntimeError):
    """Raised under ``on_fail="raise"``."""


def generate_with_retry(
    prompts: DataFrame,
    keys: list[str],
    fn: Generate,
    parser: Parser,
    max_attempts: int,
    on_fail: str = "drop",
    result_type: str = "string",
    carry: list[str] | None = None,
    placed: bool = False,
    call_size: int = CALL_SIZE,
    store: str | None = None,
    commit_rows: int = COMMIT_ROWS,
    commit_files: int = COMMIT_FILES,
) -> DataFrame:
    """Respond to each prompt until the response parses, at most ``max_attempts`` times.

    The attempts run inside one job, and the result is written once, so the model is
    never asked again by a later action. Only the prompt goes to Python; ``carry`` names
    further columns that stay beside it, for callers that want them without a join.
    ``placed`` says that the rows have been moved apart before the prompt was built.
    Returns the keys, the carried and the parser's columns, ``attempt`` and ``error``, the
    text of what the last attempt raised. Rows that never parse are dropped, kept with
    ``ok`` false under ``on_fail="keep"``, or end the job under ``on_fail="raise"``.

    With ``store``, a folder of this job, responses are committed as they come in: see
    ``committed``.
    """
    if on_fail not in ("drop", "keep", "raise"):
        raise ValueError(f"on_fail: {on_fail}")
    kept = [*keys, *(carry or [])]
    asked = prompts.select(*kept, "prompt")
    asked = asked if placed else spread(asked, keys)

    answered = Answers(kept, fn, parser, max_attempts, result_type, call_size)
    if store is not None:
        results = committed(asked, answered, store, commit_rows, commit_files)
    else:
        results = written(answered(asked), "responses")
    if on_fail == "raise":
        failed = results.where("not ok").agg(F.count("*"), F.max("error")).first()
        if failed[0]:
            raise NoUsableResponse(f"{failed[0]} prompts without a usable response; an error among them: {failed[1]}")
    return results if on_fail == "keep" else results.where("ok")


def committed(
    asked: DataFrame, answered: Callable[[DataFrame], DataFrame], store: str, commit_rows: int, commit_files: int
) -> DataFrame:
    """Answers to ``asked``, committed below ``store`` after every ``commit_files`` files of prompts.

    The prompts are laid out once, in files of at most ``commit_rows``, and a stream works
    through them: its checkpoint knows the files that are done and its sink the batches
    that are committed. A job that was killed and is started again with the same ``store``
    asks for what no committed batch holds, and no response appears twice. The folder
    belongs to one set of prompts: later changes of ``asked`` are not seen.
    """
    spark = asked.sparkSession
    if not finished(spark, f"{store}/prompts"):
        asked.write.mode("overwrite").option("maxRecordsPerFile", commit_rows).parquet(f"{store}/prompts")
    stream = spark.readStream.schema(asked.schema).option("maxFilesPerTrigger", commit_files).parquet(f"{store}/prompts")
    rows = answered(stream)
    (
        rows.writeStream.format("parquet")
        .option("path", f"{store}/responses")
        .option("checkpointLocation", f"{store}/checkpoint")
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    if not exists(spark, f"{store}/responses"):  # there was nothing to ask
        return spark.createDataFrame([], rows.schema)
    return spark.read.schema(rows.schema).parquet(f"{store}/responses")


def embed_text(df: DataFrame, column: str, fn: Embed) -> DataFrame:
    """Add ``embedding``."""
    return df.withColumn("embedding", embedded(F.col(column), fn))


def correct_text(df: DataFrame, fn: Correct) -> DataFrame:
    """Correct input and output and audit the change; written once, so no later action asks again."""
    checked = df.withColumns(
        {
            "corrected_input": corrected(F.col("input"), fn),
            "corrected_output": corrected(F.col("output"), fn),
        }
    )
    return correction_audit(written(checked, "corrected"))
