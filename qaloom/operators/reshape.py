"""Row reshapes: wide rows to records, labels to records, vectors to columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from qaloom.schemas import NEGATIVE_CATEGORY, NEGATIVE_SCORE, OPTION_KEYS, PASSAGE_FORMAT
from qaloom.functions.templates import TRAINING, TRAINING_INSTRUCTION
from qaloom.functions.text import fill


def row_to_record(df: DataFrame) -> DataFrame:
    """One JSON record per row, missing values kept as keys."""
    return df.select(
        F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("record")
    )


def unpivot_answers(wide: DataFrame, answers: int = 5) -> DataFrame:
    """Two questions times the answers; the second question only where there is one."""
    pairs = [
        F.struct(
            F.lit(a).alias("a_no"),
            F.lit(q).alias("q_no"),
            F.col(f"q{q}").alias("input"),
            F.col(f"a{a}").alias("output"),
        )
        for a in range(1, answers + 1)
        for q in (1, 2)
    ]
    rows = wide.select("row_id", "category", F.inline(F.array(*pairs)))
    return rows.where((F.col("q_no") == 1) | F.col("input").isNotNull()).select(
        "row_id", "a_no", "q_no", "input", "output", "category"
    )


def pick_option(key: Column, answers: list[Column] | None = None) -> Column:
    """Answer text behind an option key; NULL for a key that is not there."""
    texts = answers or [F.col(k.lower()) for k in OPTION_KEYS]
    entries = [x for name, text in zip(OPTION_KEYS, texts) for x in (F.lit(name), text)]
    return F.try_element_at(F.create_map(*entries), key)


def expand_labels(wide: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled wide row to three records, all or none.

    ``labels`` has ``row_id, k1, k2, q3, a3, ok`` as ``parse_labels`` gives them.
    """
    chosen = labels.where("ok").select(
        "row_id", "k1", "k2", F.col("q3").alias("new_question"), F.col("a3").alias("new_answer")
    )
    return label_records(wide.join(chosen, "row_id"))


def label_records(rows: DataFrame) -> DataFrame:
    """The three records of wide rows that carry ``k1, k2, new_question, new_answer``."""
    records = F.array(
        F.struct(
            F.lit(1).alias("label_no"),
            F.col("q1").alias("input"),
            pick_option(F.col("k1")).alias("output"),
        ),
        F.struct(
            F.lit(2).alias("label_no"),
            F.col("q2").alias("input"),
            pick_option(F.col("k2")).alias("output"),
        ),
        F.struct(
            F.lit(3).alias("label_no"),
            F.col("new_question").alias("input"),
            F.col("new_answer").alias("output"),
        ),
    )
    return rows.select("row_id", F.inline(records), "category").select(
        "row_id", "label_no", "input", "output", "category"
    )


def vector_to_columns(
    df: DataFrame, n: int, vector: str = "embedding", prefix: str = "c"
) -> DataFrame:
    """Array of ``n`` numbers to ``n`` double columns, in place of the array."""
    kept = [c for c in df.columns if c != vector]
    return df.select(
        *kept,
        *[F.get(F.col(vector), F.lit(i)).cast("double").alias(f"{prefix}{i}") for i in range(n)],
    )


def constant_labels(
    df: DataFrame, category: str = NEGATIVE_CATEGORY, score: float = NEGATIVE_SCORE
) -> DataFrame:
    """Stamp one category and score on every row."""
    return df.withColumns({"category": F.lit(category), "average_score": F.lit(float(score))})


def correction_audit(
    df: DataFrame, corrected_input: str = "corrected_input", corrected_output: str = "corrected_output"
) -> DataFrame:
    """Take over corrected texts, flag the changed rows and keep their originals.

    A row whose correction failed (NULL in either text) is dropped.
    """
    done = df.where(F.col(corrected_input).isNotNull() & F.col(corrected_output).isNotNull())
    changed = (F.col(corrected_input) != F.col("input")) | (
        F.col(corrected_output) != F.col("output")
    )
    others = [
        c for c in df.columns if c not in ("input", "output", corrected_input, corrected_output)
    ]
    return done.select(
        *others,
        F.col(corrected_input).alias("input"),
        F.col(corrected_output).alias("output"),
        changed.alias("is_corrected"),
        F.when(changed, F.col("input")).otherwise("").alias("before_input"),
        F.when(changed, F.col("output")).otherwise("").alias("before_output"),
    )


def format_passage(df: DataFrame, template: str = PASSAGE_FORMAT) -> DataFrame:
    """Question and answer as one passage text."""
    text = fill(template, input=F.col("input"), output=F.col("output"))
    return df.select(F.col("row_id").alias("doc_id"), text.alias("passage"))


def instruction_text(
    df: DataFrame, instruction: str = TRAINING_INSTRUCTION, template: str = TRAINING
) -> DataFrame:
    """Add the training text: instruction, question, answer."""
    return df.withColumn(
        "text",
        fill(template, instruction=F.lit(instruction), input=F.col("input"), output=F.col("output")),
    )


def union_generated(base: DataFrame, *generated: DataFrame) -> DataFrame:
    """Bag union by column name; columns that one side lacks are NULL there."""
    rows = base
    for more in generated:
        rows = rows.unionByName(more, allowMissingColumns=True)
    return rows


def sort_by_category(df: DataFrame) -> DataFrame:
    return df.orderBy("category", "row_id")


def preview(df: DataFrame, n: int = 5) -> DataFrame:
    """The first ``n`` rows in row order."""
    return df.orderBy("row_id").limit(n)
