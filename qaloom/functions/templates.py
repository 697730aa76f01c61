"""Default prompt texts. Callers may pass their own with the same slots.

What the parsers look for comes from ``schemas``; the rest is this project's wording.
"""

from qaloom.schemas import ANSWER_MARKER, PAIR_MARKERS, QUESTION_MARKER, RUBRIC_MARKERS

_Q, _A = PAIR_MARKERS
_CORRECT, _COMPLETE, _NATURAL = RUBRIC_MARKERS

OPTION_SYSTEM = (
    "You are a building expert. Answer in exactly three lines.\n"
    "Line 1: '1. ' and the key of the option that answers Q1.\n"
    "Line 2: '2. ' and the key of the option that answers Q2.\n"
    "Line 3: '3. Q: ' and one question that joins Q1 and Q2, then ' A: ' and its answer."
)
OPTION_USER = (
    "First question (Q1): {q1}\nSecond question (Q2): {q2}\nThe options\n"
    "A1. {a1}\nA2. {a2}\nA3. {a3}\nA4. {a4}\nA5. {a5}\n"
)
PAIR = (
    "You are a building expert. Write one new question and its answer that draw on both "
    "pairs below. Start the question with 'Q: ' and the answer, on the next line, with 'A: '.\n"
    "One pair asks: {q1}\nand is answered: {a1}\n\nThe other pair asks: {q2}\nand is answered: {a2}\n"
)
RUBRIC = (
    "You are a building expert. Give the answer below a whole mark from 0 to 5 for each line.\n"
    + f"{_CORRECT}how correct it is{_COMPLETE}how complete it is{_NATURAL}how natural it reads\n"
    + f"{_Q}{{question}}{_A}{{answer}}\n"
)
ANSWER_INSTRUCTION = "You are a building expert. Answer the question below, without links."
ANSWER = f"{{instruction}}\n\n{QUESTION_MARKER}{{question}}\n{ANSWER_MARKER}"
CONTEXT = "Use these passages.\n{context}\n" + ANSWER
TRAINING_INSTRUCTION = "You are a building expert. Answer the question below."
TRAINING = f"{{instruction}}\n\n{QUESTION_MARKER}{{input}}\n{ANSWER_MARKER}{{output}}"
