"""Writers. A folder of part files stands for the single file of a desktop tool."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, functions as F

from qaloom.functions.text import format_score
from qaloom.schemas import PASSAGE_HEADER


def _as_records(df: DataFrame) -> DataFrame:
    """Scores leave as text with two decimals, the correction flag as ``True``/``False``."""
    types = dict(df.dtypes)
    texts = {}
    if types.get("average_score") == "double":
        texts["average_score"] = format_score(F.col("average_score"))
    if types.get("is_corrected") == "boolean":
        texts["is_corrected"] = F.initcap(F.col("is_corrected").cast("string"))
    return df.withColumns(texts) if texts else df


def write_jsonl(df: DataFrame, path: str) -> None:
    """Replace ``path`` by line-delimited JSON, raw UTF-8, every key on every line."""
    _as_records(df).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def append_jsonl(df: DataFrame, path: str, key: str | None = None) -> None:
    """Append records; with ``key``, leave out the rows that ``path`` already holds."""
    spark = df.sparkSession
    pending = df
    if key is not None:
        try:
            done = spark.read.schema(df.select(key).schema).json(path)
        except AnalysisException as missing:
            if "PATH_NOT_FOUND" not in (missing.getCondition() or ""):
                raise
        else:
            pending = df.join(done.select(key), key, "left_anti")
    _as_records(pending).write.mode("append").option("ignoreNullFields", False).json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; quotes are doubled, newlines stay inside quotes."""
    (
        df.write.mode("overwrite")
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def write_passages(df: DataFrame, path: str, column: str = "passage") -> None:
    """One-column CSV of formatted passages."""
    write_csv(df.select(F.col(column).alias(PASSAGE_HEADER)), path)


def write_submission(df: DataFrame, path: str) -> None:
    """Wide CSV: the id, then one column per vector component."""
    write_csv(df.drop("row_id"), path)


def write_vectors(df: DataFrame, path: str) -> None:
    """Vector table with its text."""
    df.select("doc_id", "page_content", "embedding").write.mode("overwrite").parquet(path)
