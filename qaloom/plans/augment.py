"""Rounds of augmentation on a growing set."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from qaloom.functions.batch import Generate
from qaloom.lineage import finished, scratch_path, written, written_side
from qaloom.operators import gates, prompts, responses
from qaloom.operators.dense import RankDirectory
from qaloom.operators.generation import Answers
from qaloom.schemas import (
    AUGMENT_ROUNDS,
    CATEGORIES,
    DEFAULT_SCORE,
    MAX_LENGTH,
    MIN_LENGTH,
    MIN_SCORE,
    PAIR_ATTEMPTS,
    SCORE_ATTEMPTS,
)

# Rounds whose possible draws are fetched from the base set in one pass. A window costs one
# pass over the ids and one over the texts, and about this number squared of rows for each
# listed category.
WINDOW = 50


def augment_rounds(
    qa: DataFrame,
    write_pair: Generate,
    score: Generate,
    seed: int | str,
    rounds: int = AUGMENT_ROUNDS,
    categories: list[str] | None = None,
    window: int = WINDOW,
    folder: str | None = None,
) -> DataFrame:
    """Generated rows ``round, category, idx, input, output, average_score``.

    Per round and category: draw two different rows of the current set, write a pair
    from them, gate it by length, then by score, and add it to the set. All categories
    go in one job per round: a category draws only from its own rows, so this equals
    taking them one after the other.

    The set is the base and the round table, a folder of written rounds on shared storage.
    Draw, texts, model calls and gates of a round are one job that ends in its folder; the
    driver holds counts and positions: how many rows a category has, and which round added
    the row at a position. Where a draw falls depends only on those counts, so the places
    that the draws of the next ``window`` rounds can fall on are known beforehand; they are
    located in the rank directory, and their texts fetched from the base in one pass. A
    round reads those few rows and the rounds it draws from, never the base set.

    Rounds that ``folder`` already holds are taken as they are, so a job that was killed
    goes on where it stopped.
    """
    names = categories or CATEGORIES
    spark = qa.sparkSession
    known = gates.category_in(qa, names)
    directory = RankDirectory(known, "category", "row_id", seed, skip_first=True)
    base = {r["category"]: r["pool_n"] for r in directory.sizes().collect()}  # one row per listed category
    kinds = dict(qa.dtypes)
    texts = f"category string, idx long, input {kinds['input']}, output {kinds['output']}"
    made = f"{texts}, average_score double"
    root = folder or scratch_path(spark, "augment")
    held, added_in, fetched = dict(base), {}, None
    step = Round(write_pair, score)
    for number in range(rounds):
        path = f"{root}/round={number}"
        if number % window == 0:
            fetched = None
        if not finished(spark, path):
            draws = [
                (c, slot, idx, n)
                for c, n in held.items()
                if (two := _two(n, f"{number}|{c}|{seed}"))
                for slot, idx in enumerate(two)
            ]
            if not draws:
                break
            if fetched is None:
                last = min(rounds, number - number % window + window)
                fetched = _window(known, directory, base, held, seed, number, last, texts)
            earlier = sorted({added_in[c, i] for c, _, i, _ in draws if i >= base[c]})
            rows = spark.read.schema(texts).parquet(fetched, *(f"{root}/round={r}" for r in earlier))
            step(rows, draws).write.mode("overwrite").parquet(path)
        # Names only, one row per listed category at most.
        for (c,) in spark.read.schema(made).parquet(path).select("category").collect():
            added_in[c, held[c]] = number
            held[c] += 1
    if not finished(spark, f"{root}/round=0"):
        return spark.createDataFrame([], f"round int, {made}")
    done = [f"{root}/round={r}" for r in sorted(set(added_in.values()))] or [f"{root}/round=0"]
    return spark.read.schema(f"{made}, round int").option("basePath", root).parquet(*done).select("round", *(c.split()[0] for c in made.split(", ")))


class Round:
    """One round: the drawn texts, a new pair per category, and both gates.

    The expressions are the same in every round and are made once.
    """

    def __init__(self, write_pair: Generate, score: Generate):
        side = lambda slot: F.max(F.when(F.col("slot") == slot, F.struct("input", "output")))
        self.sides = side(0).alias("one"), side(1).alias("two")
        texts = {"q1": "one.input", "a1": "one.output", "q2": "two.input", "a2": "two.output"}
        keys = ["category", "n"]
        self.pair = [*map(F.col, keys), *(F.col(c).alias(name) for name, c in texts.items())]
        self.pair_prompt = [*map(F.col, keys), prompts.pair_prompt().alias("prompt")]
        self.write = Answers(keys, write_pair, responses.PAIR, PAIR_ATTEMPTS)
        self.usable = F.col("ok") & F.length("output").between(MIN_LENGTH, MAX_LENGTH)
        draft = ["category", "n", "input", "output"]
        self.draft_prompt = [*map(F.col, draft), prompts.rubric_prompt().alias("prompt")]
        self.mark = Answers(draft, score, responses.RUBRIC, SCORE_ATTEMPTS)
        # A draft that cannot be scored gets the default, as in ``score_rows``.
        points = F.coalesce("average", F.lit(DEFAULT_SCORE)).alias("average_score")
        self.out = [F.col("category"), F.col("n").alias("idx"), F.col("input"), F.col("output"), points]
        self.passed = F.col("average_score") >= MIN_SCORE

    def __call__(self, rows: DataFrame, draws: list[tuple]) -> DataFrame:
        # Two rows per listed category, in the plan itself: nothing runs to make them.
        columns = zip(("category", "slot", "idx", "n"), zip(*draws))
        drawn = F.broadcast(rows.sparkSession.createDataFrame(pa.table({name: list(values) for name, values in columns})))
        # So few rows need no exchange. Nothing is stored in between: the round's folder is
        # the one place that its rows are written to.
        pairs = rows.join(drawn, ["category", "idx"]).coalesce(1).groupBy("category", "n").agg(*self.sides)
        drafts = self.write(pairs.select(*self.pair).select(*self.pair_prompt)).where(self.usable)
        return self.mark(drafts.select(*self.draft_prompt)).select(*self.out).where(self.passed)


def _window(
    known: DataFrame,
    directory: RankDirectory,
    base: dict[str, int],
    held: dict[str, int],
    seed: int | str,
    start: int,
    stop: int,
    texts: str,
) -> str:
    """Folder of the base rows that a draw of rounds ``start`` to ``stop`` can fall on.

    A round adds none or one row to a category, so round r knows r - start + 1 sizes.
    """
    spark = known.sparkSession
    places = {
        (c, i)
        for c, n in held.items()
        for number in range(start, stop)
        for added in range(number - start + 1)
        for i in _two(n + added, f"{number}|{c}|{seed}") or ()
        if i < base[c]
    }
    path = scratch_path(spark, "augment-window")
    if not places:
        spark.createDataFrame([], texts).write.parquet(path)
        return path
    ids = directory.locate(spark.createDataFrame(sorted(places), "category string, idx long"))
    ids = written_side(ids.select(F.col("category").alias("_c"), "idx", "row_id"), "augment-places")
    rows = known.select("row_id", "input", "output").join(ids, "row_id")
    written(rows.select(F.col("_c").alias("category"), "idx", "input", "output"), "augment-window", path)
    return path


def _two(n: int, key: str) -> tuple[int, int] | None:
    """Two different positions below ``n``, ordered, from a hash."""
    if n < 2:
        return None

    def draw(what: str, size: int) -> int:
        return int(hashlib.md5(f"{key}|{what}".encode()).hexdigest()[:15], 16) % size

    first, second = draw("first", n), draw("second", n - 1)
    return first, second + (second >= first)
