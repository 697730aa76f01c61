"""Random partners within a category, samples per category, pairs across categories.

Draws are hashes of row ids, so a result does not depend on partitioning or retries.
Only narrow rows (ids, categories, positions) are indexed and matched; the texts join
afterwards by the unique row id, which no hot category can skew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from qaloom.functions.hashing import hash_draw, stable_hash
from qaloom.lineage import BROADCAST_ROWS, written, written_side
from qaloom.operators.dense import RankDirectory, StoredIndex, hash_index
from qaloom.operators.gates import category_in
from qaloom.operators.reshape import constant_labels
from qaloom.schemas import CATEGORIES, MINORITY_CATEGORIES, NEGATIVE_DRAWS


def category_partner(
    qa: DataFrame,
    seed: int | str,
    question: str = "input",
    answer: str = "output",
    skip_first: bool = True,
    repeats: int = 1,
    index: StoredIndex | None = None,
) -> DataFrame:
    """One partner per row and repeat, drawn with replacement from the row's category.

    The pool lacks the category's first row unless ``skip_first`` is off; a row may
    draw itself; an empty pool gives no pair. Rows without a category are one category.
    With an ``index`` of ``qa`` by category and ``row_id`` (which then decides seed of the
    order and first rows), nothing is indexed anew and only the draws move to meet it.
    """
    indexed = index.rows() if index else hash_index(qa, "category", "row_id", seed, skip_first)
    draws = indexed.select(
        "category",
        "row_id",
        "pool_n",
        F.explode(F.sequence(F.lit(1), F.lit(repeats))).alias("draw_no"),
    ).select(
        "category",
        "row_id",
        "draw_no",
        hash_draw(
            stable_hash(F.concat_ws("|", "row_id", "draw_no"), f"{seed}|partner"), F.col("pool_n")
        ).alias("idx"),
    )
    if index:
        drawn = index.locate(draws.withColumnRenamed("row_id", "own_id"))
        links = drawn.select(F.col("own_id").alias("row_id"), "draw_no", F.col("row_id").alias("partner_id"))
    else:
        pool = indexed.where(F.col("idx").isNotNull()).select(
            "category", "idx", F.col("row_id").alias("partner_id")
        )
        same = draws["category"].eqNullSafe(pool["category"]) & (draws["idx"] == pool["idx"])
        links = draws.join(pool, same).select("row_id", "draw_no", "partner_id")
    own = qa.select(
        "row_id", F.col(question).alias("q1"), F.col(answer).alias("a1"), "category"
    )
    partner = qa.select(
        F.col("row_id").alias("partner_id"), F.col(question).alias("q2"), F.col(answer).alias("a2")
    )
    return (
        links.join(own, "row_id")
        .join(partner, "partner_id")
        .select("row_id", "draw_no", "partner_id", "q1", "a1", "q2", "a2", "category")
    )


def minority_partner(
    qa: DataFrame,
    seed: int | str,
    categories: list[str] | None = None,
    repeats: int = 3,
    question: str = "input",
    answer: str = "output",
    skip_first: bool = True,
) -> DataFrame:
    """``category_partner`` for the rows of the minority categories, several times over."""
    rows = category_in(qa, categories or MINORITY_CATEGORIES)
    return category_partner(rows, seed, question, answer, skip_first, repeats)


def category_sample_two(
    qa: DataFrame, seed: int | str, skip_first: bool = True
) -> DataFrame:
    """Two different rows per category, in draw order, from the category's pool.

    The draw reads ids and categories only: every task keeps its three lowest hashes per
    category before the shuffle, so a hot category costs three narrow rows per task. The
    draw is written and counted first, so that the texts need not be shuffled to meet it.
    A category with fewer than two rows in its pool gives none.
    """
    lowest = Window.partitionBy("category").orderBy("_hash", "row_id")
    digest = stable_hash(F.col("row_id"), f"{seed}|sample")
    drawn = (
        qa.select("category", "row_id", digest.alias("_hash"))
        .withColumn("_rank", F.row_number().over(lowest))
        .where(F.col("_rank") <= 3)
    )
    if skip_first:
        firsts = qa.groupBy(F.col("category").alias("_of")).agg(F.min("row_id").alias("_first"))
        drawn = drawn.join(firsts, F.col("category").eqNullSafe(F.col("_of"))).where(F.col("row_id") != F.col("_first"))
    drawn = drawn.withColumn("slot", F.row_number().over(lowest)).where(F.col("slot") <= 2)
    picks = written_side(drawn.select("row_id", "slot"), "sample")

    rows = qa.select("category", "row_id", "input", "output").join(picks, "row_id")
    row = F.struct("row_id", "input", "output")
    sides = rows.groupBy("category").agg(
        F.max(F.when(F.col("slot") == 1, row)).alias("one"),
        F.max(F.when(F.col("slot") == 2, row)).alias("two"),
    )
    return sides.where(F.col("one").isNotNull() & F.col("two").isNotNull()).select(
        "category",
        F.col("one.row_id").alias("row_id_1"),
        F.col("one.input").alias("q1"),
        F.col("one.output").alias("a1"),
        F.col("two.row_id").alias("row_id_2"),
        F.col("two.input").alias("q2"),
        F.col("two.output").alias("a2"),
    )


def negative_pairs(
    qa: DataFrame,
    seed: int | str,
    categories: list[str] | None = None,
    n: int = NEGATIVE_DRAWS,
    index: StoredIndex | None = None,
) -> DataFrame:
    """``n`` questions, each with an answer from another category.

    The category of the question is drawn from the list, the category of the answer
    from the rest of the list, and the rows from the whole of those categories. The
    second draw skips the first category by position, so both joins are on equality. A
    draw that meets an empty category gives no pair.
    """
    names = categories or CATEGORIES
    listed = F.array(*[F.lit(c) for c in names])
    draw = qa.sparkSession.range(n).select(F.col("id").alias("draw_id"))

    def drawn(what: str, size):
        return hash_draw(stable_hash(F.col("draw_id"), f"{seed}|{what}"), size)

    chosen = draw.select(
        "draw_id",
        drawn("input category", len(names)).alias("c1"),
        drawn("output category", len(names) - 1).alias("c2"),
    ).select(
        "draw_id",
        F.get(listed, F.col("c1").cast("int")).alias("input_category"),
        F.get(
            listed, (F.col("c2") + (F.col("c2") >= F.col("c1")).cast("int")).cast("int")
        ).alias("output_category"),
    )
    # One directory serves both sides: sizes to draw from, then the drawn rows' ids. Only
    # the hash buckets that a draw falls into are ranked.
    directory = index or RankDirectory(category_in(qa, names), "category", "row_id", seed)
    sizes = F.broadcast(directory.sizes())  # at most one row per listed category
    picks = chosen.select(
        "draw_id",
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(side).alias("side"), F.col(f"{side}_category").alias("category"))
                    for side in ("input", "output")
                ]
            )
        ),
    ).join(sizes, "category")
    positions = picks.select(
        "draw_id",
        "side",
        "category",
        F.when(F.col("side") == "input", drawn("input row", F.col("pool_n")))
        .otherwise(drawn("output row", F.col("pool_n")))
        .alias("idx"),
    )
    located = written(directory.locate(positions), "negative-rows")

    def row_of(side: str) -> DataFrame:
        return located.where(F.col("side") == side).select("draw_id", F.col("row_id").alias(f"{side}_row"))

    pairs = _small(row_of("input").join(row_of("output"), "draw_id"), n)
    # Each text side is read once past the broadcast ids; only the drawn rows move.
    questions = qa.select(
        F.col("row_id").alias("input_row"), "input", F.col("category").alias("input_category")
    ).join(pairs, "input_row")
    answers = (
        qa.select(
            F.col("row_id").alias("output_row"), "output", F.col("category").alias("output_category")
        )
        .join(pairs.select("draw_id", "output_row"), "output_row")
        .drop("output_row")
    )
    joined = questions.join(answers, "draw_id").select(
        "draw_id", "input_row", "output_row", "input_category", "output_category", "input", "output"
    )
    return constant_labels(joined)


def _small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast a side that is known to have few enough rows; else leave it to Spark."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df
