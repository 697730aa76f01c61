"""Offline functions in place of the external models, each with its SQL equivalent.

They are deterministic in the text they get, fail for some texts always and for some
only at first, so the queries exercise the retries.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

from qaloom.schemas import ANSWER_MARKER, RUBRIC_MARKERS

VECTOR_SIZE = 64


def _md5(text: str) -> str:
    return hashlib.md5(text.encode()).hexdigest()


def score(prompts: list[str], attempt: int) -> list[str]:
    def one(prompt: str) -> str:
        digits = [int(d, 16) for d in _md5(prompt)[:5]]
        if digits[3] % 8 == 0 or (digits[4] % 4 == 0 and attempt < 3):
            return "no marks"
        return "".join(f"{m}{5 - d % 6}" for m, d in zip(RUBRIC_MARKERS, digits))

    return [one(p) for p in prompts]


def _sql_digit(prompt: str, place: int) -> str:
    return f"('0x' || substr(md5({prompt}), {place}, 1))::BIGINT"


def sql_never_scored(prompt: str) -> str:
    return f"{_sql_digit(prompt, 4)} % 8 = 0"


def sql_scored_late(prompt: str) -> str:
    return f"{_sql_digit(prompt, 5)} % 4 = 0"


def sql_score(prompt: str) -> str:
    """Average score, the default where there are never marks."""
    marks = " + ".join(f"5 - {_sql_digit(prompt, i)} % 6" for i in (1, 2, 3))
    return f"CASE WHEN {sql_never_scored(prompt)} THEN 3.0::DOUBLE ELSE ({marks})::DOUBLE / 3 END"


def write_pair(prompts: list[str], attempt: int) -> list[str | None]:
    def one(prompt: str) -> str | None:
        n = len(prompt)
        if n % 7 == 0:
            return None
        if n % 3 == 0 and attempt == 1:
            return "nothing to say"
        digest = _md5(prompt)
        return f"Q: q-{digest}\nA: {digest * (3 + n % 8)}"

    return [one(p) for p in prompts]


def sql_write_pair(prompt: str) -> tuple[str, str, str]:
    """Whether there is a pair, its question, its answer."""
    return (
        f"length({prompt}) % 7 <> 0",
        f"'q-' || md5({prompt})",
        f"repeat(md5({prompt}), CAST(3 + length({prompt}) % 8 AS INTEGER))",
    )


def choose(prompts: list[str], attempt: int) -> list[str]:
    def one(prompt: str) -> str:
        n = len(prompt)
        if n % 7 == 0 or (n % 2 == 0 and attempt == 1):
            return "1. A9\n2. A1\n3. Q: none A: none"
        digest = _md5(prompt)
        return f"1. A{n % 5 + 1}\n2. A{(n + 2) % 5 + 1}\n3. Q: q-{digest} A: a-{digest}"

    return [one(p) for p in prompts]


def answer(prompts: list[str], attempt: int) -> list[str]:
    return [
        "no answer" if len(p) % 13 == 0 else f"{p}a-{_md5(p)} {ANSWER_MARKER}again"
        for p in prompts
    ]


def sql_answer(prompt: str) -> str:
    return f"CASE WHEN length({prompt}) % 13 <> 0 THEN 'a-' || md5({prompt}) || ' ' END"


def answer_in_chunks(prompts: list[str], attempt: int) -> list[list[str]]:
    return [[] if len(p) % 13 == 0 else [f"c-{_md5(p)}", " and more"] for p in prompts]


def sql_answer_in_chunks(prompt: str) -> str:
    return f"CASE WHEN length({prompt}) % 13 <> 0 THEN 'c-' || md5({prompt}) END"


def embed(texts: list[str]) -> list[list[float]]:
    """Word counts in hashed slots."""
    slots: dict[str, int] = {}

    def one(text: str) -> list[float]:
        counts = [0.0] * VECTOR_SIZE
        for word, times in Counter(text.split(" ")).items():
            if word not in slots:
                slots[word] = int(_md5(word)[:4], 16) % VECTOR_SIZE
            if word:
                counts[slots[word]] += times
        return counts

    return [one(t) for t in texts]


def sql_embed(source: str, key: str, text: str, name: str) -> str:
    """Common table expression ``name(key, slot, value)``, every slot present."""
    return f"""{name}_words AS (
  SELECT {key}, unnest(string_split({text}, ' ')) AS word FROM {source}),
{name}_counts AS (
  SELECT {key}, ('0x' || substr(md5(word), 1, 4))::BIGINT % {VECTOR_SIZE} AS slot,
         count(*)::DOUBLE AS value
  FROM {name}_words WHERE word <> '' GROUP BY 1, 2),
{name} AS (
  SELECT s.{key}, r.slot, coalesce(c.value, 0) AS value
  FROM {source} s
  JOIN (SELECT unnest(range({VECTOR_SIZE})) AS slot) r ON true
  LEFT JOIN {name}_counts c ON c.{key} = s.{key} AND c.slot = r.slot)"""


def correct(texts: list[str]) -> list[str | None]:
    """Single spaces; fails on a text with an at-sign."""
    return [None if "@" in t else re.sub(" +", " ", t) for t in texts]


def sql_correct(text: str) -> str:
    return (
        f"CASE WHEN NOT contains({text}, '@') "
        f"THEN regexp_replace({text}, ' +', ' ', 'g') END"
    )
