"""Answers laid out as the submission table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def positional_fallback_join(
    template: DataFrame, outputs: DataFrame, by: str = "row_id"
) -> DataFrame:
    """Template rows with the vector of the matching answer in place of their numbers.

    ``template`` has ``row_id, id`` and the numeric columns, ``outputs`` has ``embedding``
    and the matching column: ``row_id`` (position in the file) or ``id``. A row without a
    usable vector (none, or not one number per column) keeps the template's numbers. By
    id, the last answer counts where ``outputs`` has several and gives their ``row_id``.
    """
    numbers = [c for c in template.columns if c not in ("row_id", "id")]
    vectors = outputs.select(by, F.col("embedding").alias("_vector"))
    if by != "row_id" and "row_id" in outputs.columns:
        vectors = outputs.groupBy(by).agg(F.max_by("embedding", "row_id").alias("_vector"))
    usable = F.size("_vector") == len(numbers)
    joined = template.join(vectors, by, "left")
    return joined.select(
        "row_id",
        "id",
        *[
            F.when(usable, F.get("_vector", F.lit(i)).cast("double")).otherwise(F.col(c)).alias(c)
            for i, c in enumerate(numbers)
        ],
    )
