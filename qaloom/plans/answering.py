"""Answer a table of questions, with or without retrieved passages."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from qaloom.functions.batch import Embed, Generate
from qaloom.lineage import written
from qaloom.operators import prompts, responses, retrieval
from qaloom.operators.generation import embed_text, generate_with_retry, spread
from qaloom.operators.submission import positional_fallback_join
from qaloom.schemas import NEIGHBOURS


def answer_questions(questions: DataFrame, fn: Generate) -> DataFrame:
    """``id, input, output``: the text behind the answer marker of what ``fn`` returns.

    ``fn`` returns the prompt with its continuation. A text without the marker leaves the
    answer NULL, so that the question keeps its line in the submission. The position of
    the question (``row_id``), where there is one, stays with its answer.
    """
    place = _place(questions)
    asked = questions.select("id", *place, "question", prompts.answer_prompt().alias("prompt"))
    made = generate_with_retry(
        asked, ["id"], fn, responses.ANSWER, max_attempts=1, on_fail="keep", carry=[*place, "question"]
    )
    return _answers(made, place)


def build_index(passages: DataFrame, fn: Embed, path: str | None = None) -> DataFrame:
    """Embed ``doc_id, page_content`` once and read the vectors back."""
    texts = spread(passages.select("doc_id", "page_content"), ["doc_id"])
    vectors = embed_text(texts, "page_content", fn)
    return written(vectors, "vectors", path)


def retrieve_and_answer(
    questions: DataFrame,
    passages: DataFrame,
    embed: Embed,
    fn: Generate,
    k: int = NEIGHBOURS,
) -> DataFrame:
    """``id, input, output``: first chunk of the response to context and question.

    Each different question is embedded and searched once, so repeated ids and repeated
    questions keep their lines. ``passages`` is a vector table as ``build_index`` gives it; ``fn`` returns each
    response as a list of chunks. The hits are written before the texts join: they are
    the costly part, and their file size tells Spark whether to broadcast them, so the
    passage texts need not be shuffled.
    """
    place = _place(questions)
    keyed = questions.select("id", *place, "question", F.md5("question").alias("question_key"))
    texts = keyed.where(F.col("question").isNotNull()).select(F.col("question_key").alias("id"), "question").distinct()
    asked = written(embed_text(texts, "question", embed), "asked")
    hits = written(
        retrieval.knn_join(asked.select("id", "embedding"), passages.select("doc_id", "embedding"), k),
        "hits",
    )
    contexts = retrieval.join_context(hits, passages).withColumnRenamed("id", "question_key")
    made = generate_with_retry(
        prompts.build_context_prompt(keyed, contexts, "question_key", carry=["id", *place, "question"]),
        ["id"],
        fn,
        responses.FIRST_CHUNK,
        max_attempts=1,
        on_fail="keep",
        result_type="array<string>",
        carry=[*place, "question"],
    )
    return _answers(made, place)


def _place(questions: DataFrame) -> list[str]:
    return ["row_id"] if "row_id" in questions.columns else []


def _answers(made: DataFrame, place: list[str]) -> DataFrame:
    return made.select(*place, "id", F.col("question").alias("input"), F.col("answer").alias("output"))


def build_submission(
    outputs: DataFrame, template: DataFrame, embed: Embed, by: str = "row_id"
) -> DataFrame:
    """Embed the answers and lay them out on the template, by position or by id."""
    kept = [c for c in ("row_id", "id") if c == by or (c == "row_id" and c in outputs.columns)]
    vectors = embed_text(spread(outputs.select(*kept, "output"), [by]), "output", embed)
    return positional_fallback_join(template, vectors, by)
