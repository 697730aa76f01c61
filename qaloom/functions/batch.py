"""Caller-supplied text functions, run on Arrow batches.

The functions get a list of at most ``CALL_SIZE`` texts. If a call raises, its texts are
tried one by one, so one bad text costs only itself; the last error stays beside the
answer. All are declared non-deterministic, even where they are not: otherwise a filter
derived from the result (``explode`` derives one) makes Spark call the function a second
time.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

Generate = Callable[[list[str], int], Sequence[Any]]
Embed = Callable[[list[str]], Sequence[Sequence[float]]]
Correct = Callable[[list[str]], Sequence[str | None]]


# Texts of one call. Services take a few dozen at most, and an Arrow batch has thousands.
CALL_SIZE = 32


def _each(fn: Callable[[list[str]], Sequence[Any]], texts: list[str], size: int = CALL_SIZE) -> list[tuple[Any, str | None]]:
    """Result and error of every text."""
    out: list[tuple[Any, str | None]] = []
    for start in range(0, len(texts), size):
        some = texts[start : start + size]
        try:
            out += [(value, None) for value in _sized(fn(some), len(some))]
        except Exception as error:
            out += [(None, f"{type(error).__name__}: {error}")] if len(some) == 1 else _each(fn, some, 1)
    return out


def _sized(results: Sequence[Any], n: int) -> list[Any]:
    values = list(results)
    if len(values) != n:
        raise ValueError(f"{len(values)} results for {n} texts")
    return values


def _over(texts: pd.Series, fn: Callable[[list[str]], Sequence[Any]]) -> pd.Series:
    """Results in place, NULL where the text is NULL or the function failed."""
    known = [t for t in texts if t is not None]
    results = iter(_each(fn, known))
    return pd.Series([None if t is None else next(results)[0] for t in texts], dtype=object)


def generated(
    prompt: Column,
    fn: Generate,
    readable: Callable[[Any], bool],
    max_attempts: int,
    result_type: str = "string",
    call_size: int = CALL_SIZE,
) -> Column:
    """Struct of the last response to each prompt, the number of attempts and the last error.

    Only the prompts whose response is not ``readable`` are asked again, within the same
    batch: one Python worker per task, whatever the number of attempts. The error is NULL
    where the last attempt raised none.
    """

    @F.pandas_udf(f"response {result_type}, attempt int, error string")
    def ask(prompts: pd.Series) -> pd.DataFrame:
        texts = list(prompts)
        responses: list[Any] = [None] * len(texts)
        errors: list[str | None] = [None] * len(texts)
        attempts = [max_attempts] * len(texts)
        pending = [i for i, text in enumerate(texts) if text is not None]
        for attempt in range(1, max_attempts + 1):
            if not pending:
                break
            asked = [texts[i] for i in pending]
            for i, (answer, error) in zip(pending, _each(lambda some: fn(some, attempt), asked, call_size)):
                responses[i], errors[i], attempts[i] = answer, error, attempt
            pending = [i for i in pending if responses[i] is None or not readable(responses[i])]
        return pd.DataFrame(
            {
                "response": pd.Series(responses, dtype=object),
                "attempt": attempts,
                "error": pd.Series(errors, dtype=object),
            }
        )

    return ask.asNondeterministic()(prompt)


def corrected(text: Column, fn: Correct) -> Column:
    """Corrected text, NULL where the correction failed."""

    @F.pandas_udf("string")
    def correct(texts: pd.Series) -> pd.Series:
        return _over(texts, fn)

    return correct.asNondeterministic()(text)


def embedded(text: Column, fn: Embed) -> Column:
    """Vector of each text, NULL where the text is NULL or the function failed."""

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        vectors = _over(texts, fn)
        return vectors.map(lambda v: None if v is None else np.asarray(v, dtype=np.float32))

    return embed.asNondeterministic()(text)
