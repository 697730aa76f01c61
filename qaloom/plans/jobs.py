"""Whole jobs: label, synthesize, score, curate, build the candidate and training sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from qaloom.functions.batch import Correct, Generate
from qaloom.operators import gates, pairing, prompts, reshape, responses, stats
from qaloom.operators.generation import correct_text, generate_with_retry, spread
from qaloom.operators.split import stratified_folds
from qaloom.schemas import DEFAULT_SCORE, FOLDS, PAIR_ATTEMPTS, SCORE_ATTEMPTS


def score_rows(
    qa: DataFrame,
    fn: Generate,
    keys: list[str] | None = None,
    max_attempts: int = SCORE_ATTEMPTS,
    default: float = DEFAULT_SCORE,
    on_fail: str = "default",
    error: str | None = None,
    **calls,
) -> DataFrame:
    """Add (or replace) ``average_score`` and ``score_defaulted``.

    A row that cannot be scored gets the default, which passes the usual gate; ``error``
    names a column for what its last attempt raised, and ``on_fail="raise"`` ends the job
    instead, so that an outage does not pass as a score. The rows themselves are written
    with their score: ``qa`` is evaluated once and nothing joins. ``calls`` goes to
    ``generate_with_retry``.
    """
    by = keys or ["row_id"]
    made = ("average_score", "score_defaulted", error)
    columns = [c for c in qa.columns if c not in made]
    marks = generate_with_retry(
        prompts.build_rubric_prompt(spread(qa.select(*columns), by), columns),
        by,
        fn,
        responses.RUBRIC,
        max_attempts,
        on_fail="raise" if on_fail == "raise" else "keep",
        carry=[c for c in columns if c not in by],
        placed=True,
        **calls,
    )
    return marks.select(
        *columns,
        F.coalesce("average", F.lit(default)).alias("average_score"),
        F.col("average").isNull().alias("score_defaulted"),
        *([F.col("error").alias(error)] if error else []),
    )


def label_options(
    wide: DataFrame, fn: Generate, max_attempts: int = PAIR_ATTEMPTS
) -> DataFrame:
    """Let the model choose the answers and write a joint pair: three records per row."""
    # The row goes along under one name, since the parsed columns share names with its own.
    asked = wide.select("row_id", F.struct(*[c for c in wide.columns if c != "row_id"]).alias("wide"), prompts.option_prompt().alias("prompt"))
    labels = generate_with_retry(asked, ["row_id"], fn, responses.LABELS, max_attempts, carry=["wide"])
    chosen = labels.select("row_id", "wide.*", "k1", "k2", F.col("q3").alias("new_question"), F.col("a3").alias("new_answer"))
    return reshape.label_records(chosen)


def write_pairs(pairs: DataFrame, keys: list[str], fn: Generate, **calls) -> DataFrame:
    """A new question and answer for each pair of pairs; rows that never parse drop out."""
    by = [*keys, "category"]
    made = generate_with_retry(
        prompts.build_pair_prompt(pairs, by), by, fn, responses.PAIR, PAIR_ATTEMPTS, **calls
    )
    return made.select(*by, "input", "output")


def synthesize_pairs(
    qa: DataFrame,
    fn: Generate,
    seed: int | str,
    question: str = "input",
    answer: str = "output",
    categories: list[str] | None = None,
    repeats: int = 1,
) -> DataFrame:
    """Pair every row with a partner of its category and write a new pair from both."""
    rows = qa if categories is None else gates.category_in(qa, categories)
    pairs = pairing.category_partner(rows, seed, question, answer, repeats=repeats)
    made = write_pairs(pairs, ["row_id", "draw_no"], fn)
    return made.select("row_id", "draw_no", "input", "output", "category")


def curate(
    qa: DataFrame,
    score: Generate,
    correct: Correct | None = None,
    markers: list[str] | None = None,
) -> DataFrame:
    """Length band, marker filter, scoring, score gate and, if given, correction."""
    kept = gates.drop_marked(gates.length_quantile_band(qa), markers)
    passed = gates.score_gate(score_rows(kept, score))
    return passed if correct is None else correct_text(passed, correct)


def candidate_set(wide: DataFrame, score: Generate) -> tuple[DataFrame, DataFrame]:
    """Every question with every answer, of fitting length and score, and the report.

    The length gate comes before the model: the gates commute, the calls cost.
    """
    rows = gates.length_range(reshape.unpivot_answers(wide))
    # Scoring has written the rows; the gate is a filter over that table.
    kept = gates.score_gate(score_rows(rows, score, ["row_id", "a_no", "q_no"]))
    return kept, stats.dataset_report(kept)


def training_set(
    qa: DataFrame, seed: int | str, k: int = FOLDS, instruction: str | None = None
) -> DataFrame:
    """Training text and fold of each row; ``is_eval`` marks the held-out fold."""
    folds = stratified_folds(qa, seed, k)  # the text is derived after the rows have moved
    with_text = (
        reshape.instruction_text(folds)
        if instruction is None
        else reshape.instruction_text(folds, instruction)
    )
    return with_text.select(*[c for c in with_text.columns if c not in ("fold", "is_eval")], "fold", "is_eval")


def write_training_set(folds: DataFrame, path: str) -> None:
    """One folder per side (``train``, ``eval``), so that reading one skips the other."""
    side = F.when(F.col("is_eval"), "eval").otherwise("train")
    rows = folds.withColumn("side", side).drop("is_eval")
    rows.write.mode("overwrite").partitionBy("side").parquet(path)
