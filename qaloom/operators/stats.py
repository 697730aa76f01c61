"""Counts, shares, lengths, scores. Every result is small; every pass is partial + final."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from qaloom.functions.text import format_score, parse_score, text_length
from qaloom.operators.dense import hash_index
from qaloom.schemas import MIN_SCORE, MINORITY_CATEGORIES

LENGTH_QUANTILES = {"median": 0.5, "p90": 0.90, "p5": 0.05}


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"))


def category_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def category_shares(df: DataFrame) -> DataFrame:
    """Rows per category and their percentage of all rows, as a number."""
    counts = category_counts(df)
    total = counts.agg(F.sum("n")).scalar()
    return counts.select("category", "n", F.round(F.col("n") / total * 100, 2).alias("pct"))


def minority_total(df: DataFrame, categories: list[str] | None = None) -> DataFrame:
    wanted = F.col("category").isin(categories or MINORITY_CATEGORIES)
    return df.agg(F.count_if(wanted).alias("n"))


# Rows that may pass through one task to settle a quantile.
SETTLED_ROWS = 100_000
# Share of the rows on either side of a wanted place that the next round aims to keep.
MARGIN = 2e-3


def histogram_quantile(df: DataFrame, column: str, quantiles: dict[str, float]) -> DataFrame:
    """``index_quantile`` of a column with few values, as one lazy row.

    Distinct values, not rows, reach the running sum: for text lengths that is bounded by
    the longest text.
    """
    return _histogram(df.select(F.col(column).alias("v"))).agg(*_at(quantiles))


def index_quantile(df: DataFrame, column: str, quantiles: dict[str, float], settled: int = SETTLED_ROWS) -> DataFrame:
    """One row with ``sorted(x)[int(n * p)]`` for each named ``p``, NULL where there is no value.

    Exact for a column with any number of values. Each wanted place has an interval that
    holds it. A round asks a sketch for two values close to the place and counts the rows
    below and up to each: the place is one of the two, or in what they leave, so every round
    settles it or cuts the interval, whatever the sketch said. Both steps are partial sums,
    and a few numbers per quantile reach the driver. What holds at most ``settled`` rows is
    sorted; two or three rounds get there.
    """
    values = df.select(F.col(column).alias("v")).where(F.col("v").isNotNull())
    kind = values.schema["v"].dataType
    n = values.count()
    spark = df.sparkSession
    schema = T.StructType([T.StructField(name, kind) for name in quantiles])
    found: dict[str, object] = dict.fromkeys(quantiles) if not n else {}
    place = {name: min(int(n * p), n - 1) for name, p in quantiles.items()}
    value = F.col("v")
    known = lambda x: F.lit(x).cast(kind)
    # The test of each interval, the rows below it and the rows in it.
    state = {} if found else {name: (F.lit(True), 0, n) for name in quantiles}
    while open_ := [name for name, (_, _, rows) in state.items() if rows > settled]:
        guesses = []
        for name in open_:
            test, below, rows = state[name]
            at = (place[name] - below) / rows
            ends = [max(0.0, at - MARGIN), min(1.0, at + MARGIN)]
            guesses.append(F.percentile_approx(F.when(test, value), ends, int(4 / MARGIN)).alias(name))
        guess = values.agg(*guesses).first()
        tests = [test for name in open_ for x in guess[name] for test in (value < known(x), value <= known(x))]
        counts = iter(values.agg(*(F.count_if(t).alias(f"n{i}") for i, t in enumerate(tests))).first())
        for name in open_:
            test, below, rows = state[name]
            x, y = guess[name]
            under_x, upto_x, under_y, upto_y = (next(counts) for _ in range(4))
            if place[name] < under_x:
                state[name] = (test & (value < known(x)), below, under_x - below)
            elif place[name] < upto_x:
                found[name] = x
            elif place[name] < under_y:
                state[name] = (test & (value > known(x)) & (value < known(y)), upto_x, under_y - upto_x)
            elif place[name] < upto_y:
                found[name] = y
            else:
                state[name] = (test & (value > known(y)), upto_y, below + rows - upto_y)
            if name in found:
                del state[name]
    last = [
        _histogram(values.where(test)).where(F.col("cum") + below > place[name]).agg(F.min("v").alias("v")).select(F.lit(name).alias("name"), "v")
        for name, (test, below, _) in state.items()
    ]
    if last:
        rows = last[0]
        for more in last[1:]:
            rows = rows.unionByName(more)
        found |= {r["name"]: r["v"] for r in rows.collect()}  # one row per quantile
    return spark.createDataFrame([tuple(found[name] for name in quantiles)], schema)


def _histogram(values: DataFrame) -> DataFrame:
    """Rows per value ``v``, with the running and the whole count."""
    counts = values.where(F.col("v").isNotNull()).groupBy("v").agg(
        F.count(F.lit(1)).alias("n")
    )
    upto = Window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    return counts.select(
        "v",
        "n",
        F.sum("n").over(upto).alias("cum"),
        F.sum("n").over(Window.partitionBy()).alias("total"),
    )


def _at(quantiles: dict[str, float]) -> list[Column]:
    """The smallest value whose running count exceeds ``int(total * p)``."""
    return [
        F.min(F.when(F.col("cum") > F.floor(F.col("total") * F.lit(p)), F.col("v"))).alias(name)
        for name, p in quantiles.items()
    ]


def length_stats(df: DataFrame) -> DataFrame:
    """Count, mean, max, min, upper median, p90 and p5 of the output length.

    All from one histogram of lengths.
    """
    lengths = df.select(text_length(F.col("output")).alias("v"))
    return _histogram(lengths).agg(
        F.sum("n").alias("n"),
        (F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("mean_length"),
        F.max("v").alias("max_length"),
        F.min("v").alias("min_length"),
        *_at(LENGTH_QUANTILES),
    )


def score_histogram(df: DataFrame) -> DataFrame:
    """Rows per score text."""
    score = format_score(parse_score(F.col("average_score")))
    return df.groupBy(score.alias("average_score")).agg(F.count(F.lit(1)).alias("n"))


def below_threshold_count(df: DataFrame, minimum: float = MIN_SCORE) -> DataFrame:
    return df.agg(F.count_if(parse_score(F.col("average_score")) < minimum).alias("n"))


def mean_score(df: DataFrame) -> DataFrame:
    return df.agg(F.avg(parse_score(F.col("average_score"))).alias("mean_score"))


def dataset_report(df: DataFrame) -> DataFrame:
    """Count, length mean/max/min, mean score and category shares, one line each.

    One pass over the rows: a sum per category, then the totals over those few sums.
    """
    length = text_length(F.col("output"))
    score = parse_score(F.col("average_score"))
    per_category = df.groupBy("category").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(length).alias("chars"),
        F.max(length).alias("longest"),
        F.min(length).alias("shortest"),
        F.sum(score).alias("score"),
    )
    n = F.sum("n")
    metrics = {
        "count": n.cast("double"),
        "mean_length": F.sum("chars") / n,
        "max_length": F.max("longest").cast("double"),
        "min_length": F.min("shortest").cast("double"),
        "mean_score": F.sum("score") / n,
    }
    whole = per_category.agg(
        F.array(
            *[
                F.struct(F.lit(name).alias("metric"), value.alias("value"))
                for name, value in metrics.items()
            ]
        ).alias("m")
    ).select(F.inline("m")).select("metric", F.lit("").alias("category"), "value")
    total = per_category.agg(F.sum("n")).scalar()
    shares = per_category.select(
        F.lit("share").alias("metric"),
        "category",
        F.round(F.col("n") / total * 100, 2).alias("value"),
    )
    return whole.unionByName(shares)


def category_pool(
    df: DataFrame, seed: int | str, skip_first: bool = True, carry: list[str] | None = None
) -> DataFrame:
    """Rows one can draw from a category, with a dense index and the pool size."""
    indexed = hash_index(df, "category", "row_id", seed, skip_first, carry)
    return indexed.where(F.col("idx").isNotNull()).drop("is_first")
