"""Readers. Every reader that has no key column of its own adds the row's position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from qaloom.lineage import written, written_side
from qaloom.schemas import (
    MISSING_TEXTS,
    PASSAGE_HEADER,
    QA_RECORD,
    QUESTION_HEADERS,
    SCORED_RECORD,
    WIDE_HEADERS,
)


def _csv(spark: SparkSession, path: str, multi_line: bool) -> DataFrame:
    # Columns go by header name and stay text: the file decides the column order.
    # A quoted newline makes a file one split, so large inputs should be many files.
    return (
        spark.read.option("header", True)
        .option("multiLine", multi_line)
        .option("quote", '"')
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def _asked(names: dict[str, str], columns: list[str] | None) -> dict[str, str]:
    """The headers of the wanted columns; an unknown column is an error."""
    if columns is None:
        return names
    if unknown := set(columns) - set(names.values()):
        raise ValueError(f"no columns {sorted(unknown)}")
    return {head: name for head, name in names.items() if name in columns}


def _present(column: Column) -> Column:
    return F.when(~column.isin(MISSING_TEXTS), column)


def with_row_id(scan: DataFrame, name: str = "row_id", columns: list[str] | None = None) -> DataFrame:
    """Add each row's position in file order (file path, then place in the file).

    ``columns`` names those that are wanted: no others are read or written.

    Numbers inside a path count as numbers: ``part-2`` comes before ``part-10``.

    ``scan`` must come straight from a file reader. Rows of one split are read in order
    by one task, so the increasing id minus the split's lowest one is the place in the
    split. The tagged rows are written once, which settles the ids and turns the text
    into columns for all later passes. One small row per split carries the number of rows
    before it; it is counted before it is broadcast, and the data rows do not move.
    """
    kept = scan.columns if columns is None else columns
    tagged = written(
        scan.select(
            *[F.col(f"`{c}`") for c in kept],
            F.col("_metadata.file_path").alias("_file"),
            F.col("_metadata.file_block_start").alias("_block"),
            F.monotonically_increasing_id().alias("_seen"),
        ),
        "positions",
    )
    splits = tagged.groupBy("_file", "_block").agg(
        F.count(F.lit(1)).alias("n"), F.min("_seen").alias("_low")
    )
    # Digits padded to one length, so that paths compare as their numbers do.
    natural = F.array_join(
        F.transform(
            F.regexp_extract_all("_file", F.lit("[0-9]+|[^0-9]+"), 0),
            lambda x: F.when(x.rlike("^[0-9]"), F.lpad(x, 40, "0")).otherwise(x),
        ),
        "",
    )
    before = Window.orderBy(natural, "_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.select(
        F.col("_file").alias("_f"),
        F.col("_block").alias("_b"),
        (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("_low")).alias("_shift"),
    )
    starts = written_side(starts, "splits")
    joined = tagged.join(
        starts, (F.col("_file") == F.col("_f")) & (F.col("_block") == F.col("_b"))
    )
    return joined.select((F.col("_seen") + F.col("_shift")).alias(name), *[F.col(f"`{c}`") for c in kept])


def scan_wide_qa(
    spark: SparkSession,
    path: str,
    headers: dict[str, str] | None = None,
    multi_line: bool = True,
    columns: list[str] | None = None,
) -> DataFrame:
    """Wide question/answer CSV: ``row_id, q1, q2, a1..a5, category``, or only ``columns`` of these."""
    names = _asked(headers or WIDE_HEADERS, columns)
    rows = with_row_id(_csv(spark, path, multi_line), columns=list(names))
    return rows.select(
        "row_id", *[_present(F.col(f"`{head}`")).alias(name) for head, name in names.items()]
    )


def scan_questions(
    spark: SparkSession,
    path: str,
    headers: dict[str, str] | None = None,
    multi_line: bool = True,
    columns: list[str] | None = None,
) -> DataFrame:
    """Test questions: ``row_id, id, question``, or only ``columns`` of these."""
    names = _asked(headers or QUESTION_HEADERS, columns)
    rows = with_row_id(_csv(spark, path, multi_line), columns=list(names))
    return rows.select(
        "row_id", *[_present(F.col(f"`{head}`")).alias(name) for head, name in names.items()]
    )


def scan_template(spark: SparkSession, path: str, id_column: str = "id", columns: list[str] | None = None) -> DataFrame:
    """Submission template: ``row_id``, the id, and every other column (or ``columns``) as a double."""
    scan = _csv(spark, path, multi_line=False)
    numbers = [c for c in scan.columns if c != id_column and (columns is None or c in columns)]
    rows = with_row_id(scan, columns=[id_column, *numbers])
    return rows.select(
        "row_id",
        F.col(f"`{id_column}`").alias("id"),
        *[_present(F.col(f"`{c}`")).cast("double").alias(c) for c in numbers],
    )


def scan_jsonl(
    spark: SparkSession,
    path: str,
    schema: T.StructType = QA_RECORD,
    row_id: bool = False,
) -> DataFrame:
    """Line-delimited records; a bare ``NaN`` (how a missing value is written) is NULL."""
    raw = spark.read.schema(schema).json(path)
    rows = with_row_id(raw) if row_id else raw
    cleaned = [
        F.nullif(F.col(f.name), F.lit("NaN")).alias(f.name)
        if isinstance(f.dataType, T.StringType)
        else F.col(f.name)
        for f in schema.fields
    ]
    return rows.select(*(["row_id"] if row_id else []), *cleaned)


def scan_scored_jsonl(spark: SparkSession, path: str, row_id: bool = False) -> DataFrame:
    """Scored records with the score as a double, whether text or number in the file."""
    rows = scan_jsonl(spark, path, SCORED_RECORD, row_id)
    return rows.withColumn("average_score", F.col("average_score").try_cast("double"))


def scan_passages(
    spark: SparkSession,
    path: str,
    header_prefix: bool = True,
    header: str = PASSAGE_HEADER,
    multi_line: bool = True,
) -> DataFrame:
    """Passage CSV: ``doc_id, page_content``; the text starts with ``<header>: `` if asked."""
    rows = with_row_id(_csv(spark, path, multi_line), "doc_id")
    text = F.coalesce(F.col(f"`{header}`"), F.lit(""))
    if header_prefix:
        text = F.concat(F.lit(f"{header}: "), text)
    return rows.select("doc_id", text.alias("page_content"))


def scan_training_set(
    spark: SparkSession, path: str, file_format: str = "parquet"
) -> DataFrame:
    """Published question/answer set, as Parquet or as line-delimited JSON."""
    if file_format == "json":
        return scan_jsonl(spark, path, QA_RECORD, row_id=True)
    return spark.read.parquet(path)


def scan_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Saved vector table: ``doc_id, page_content, embedding``."""
    return spark.read.parquet(path)
