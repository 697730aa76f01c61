"""Record layouts and the fixed values the file formats depend on."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values -----------------------------------------------------------
# Category names, file headers, markers and formats that readers of the same
# files expect. They are data: every operator takes them as parameters.
CATEGORIES = ["건축구조", "기타", "마감재", "마감하자", "시공", "인테리어", "타 마감하자"]
MINORITY_CATEGORIES = ["건축구조", "기타", "마감하자", "타 마감하자"]
NEGATIVE_CATEGORY = "부정라벨링"
NEGATIVE_SCORE = 2.0

WIDE_HEADERS = {
    "질문_1": "q1",
    "질문_2": "q2",
    "답변_1": "a1",
    "답변_2": "a2",
    "답변_3": "a3",
    "답변_4": "a4",
    "답변_5": "a5",
    "category": "category",
}
QUESTION_HEADERS = {"id": "id", "질문": "question"}
PASSAGE_HEADER = "0"

RUBRIC_MARKERS = [
    "- 답변의 정확성(0~5점): ",
    "\n- 답변의 완성도(0~5점): ",
    "\n- 답변의 자연스러움(0~5점): ",
]
PAIR_MARKERS = ["Q: ", "\nA: "]
OPTION_MARKER = ". "
OPTION_ANSWER_MARKER = " A: "
OPTION_KEYS = ["A1", "A2", "A3", "A4", "A5"]
QUESTION_MARKER = "### 질문: "
ANSWER_MARKER = "### 답변: "
DROP_MARKERS = ["**", "책임소재", "-"]
PASSAGE_FORMAT = "###질문: {input} ###답변: {output}"
CONTEXT_SEPARATOR = "\n\n"

MIN_SCORE = 3.0
DEFAULT_SCORE = 3.0
MIN_LENGTH, MAX_LENGTH = 100, 300
LOW_QUANTILE, HIGH_QUANTILE = 0.05, 0.90
FOLDS = 20
NEIGHBOURS = 4
NEGATIVE_DRAWS = 500
AUGMENT_ROUNDS = 350
PAIR_ATTEMPTS, SCORE_ATTEMPTS = 3, 5

# Cell texts that the common data-frame CSV reader takes as missing.
MISSING_TEXTS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
    "n/a", "nan", "null",
]
# ----------------------------------------------------------------------------


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


QA_RECORD = _strings("input", "output", "category")
# The score is text in most files and a bare number in others; read as text.
SCORED_RECORD = _strings("input", "output", "category", "average_score")
AUDITED_RECORD = _strings(
    "input", "output", "category", "average_score",
    "is_corrected", "before_input", "before_output",
)
ANSWER_RECORD = _strings("id", "input", "output")
