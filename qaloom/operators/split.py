"""Stratified folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from qaloom.operators.dense import hash_index
from qaloom.schemas import FOLDS


def stratified_folds(
    df: DataFrame, seed: int | str, k: int = FOLDS, key: str = "category", row_id: str = "row_id"
) -> DataFrame:
    """Add ``fold`` and ``is_eval`` (fold 0).

    Categories in order of first appearance, shuffled inside by hash, are dealt round
    robin: class sizes differ by at most one between folds. The rows move once, spread
    by (category, hash bucket).
    """
    carry = [c for c in df.columns if c not in (key, row_id)]
    indexed = hash_index(df, key, row_id, f"{seed}|fold", carry=carry, key_order=True)
    fold = F.pmod(F.col("key_start") + F.col("idx"), F.lit(k)).cast("int")
    return indexed.select(*df.columns, fold.alias("fold"), (fold == 0).alias("is_eval"))


def train_eval_split(folds: DataFrame) -> tuple[DataFrame, DataFrame]:
    train = folds.where(~F.col("is_eval")).drop("is_eval", "fold")
    return train, folds.where("is_eval").drop("is_eval", "fold")
