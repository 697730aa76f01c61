"""Repeated strings against a direct count of every string."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest

from qaloom.llm.suffixes import digest, without_repeats


def brute(rows, length):
    data = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(d[p : p + length] for _, d in data for p in range(len(d) - length + 1))
    out = []
    for i, d in data:
        gone = [False] * len(d)
        for p in range(len(d) - length + 1):
            if seen[d[p : p + length]] > 1:
                gone[p : p + length] = [True] * length
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        kept = bytes(b for b, g in zip(d, gone) if not g)
        out.append((i, len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest(), any(gone)))
    return sorted(out, key=repr)


def texts(seed):
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("abcdefé") for _ in range(draw.randint(1, 8)))
    passages = [" ".join(word() for _ in range(n)) for n in (4, 8, 12, 20, 40, 80)]
    out = [None, "", "x", "ab" * 150, "z" * 90, passages[3], passages[3]]
    for _ in range(60):
        parts = []
        for _ in range(draw.randint(1, 6)):
            p = draw.choice(passages)
            if draw.random() < 0.5:
                a = draw.randrange(len(p))
                p = p[a : a + draw.randint(1, len(p))]
            if draw.random() < 0.3:
                k = draw.randrange(len(p))
                p = p[:k] + word() + p[k + 1 :]
            parts.append(p if draw.random() < 0.6 else " ".join(word() for _ in range(draw.randint(1, 30))))
        out.append("".join(parts))
    return out


def test_strings_of_400_bytes_and_a_very_long_text(spark):
    draw = random.Random(9)
    word = lambda: "".join(draw.choice("abcdefé") for _ in range(draw.randint(1, 8)))
    passage = " ".join(word() for _ in range(300))
    own = [" ".join(word() for _ in range(60)) for _ in range(6)]
    long = " ".join(word() for _ in range(8000))
    texts = [passage, own[0] + passage[:900], own[1] + passage[100:480] + own[2], passage[300:], own[3], long + passage[:450], long[5000:5400], long[9000:9300], "é" * 700]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = digest(without_repeats(docs)).collect()
    assert sorted(map(tuple, got), key=repr) == brute(list(enumerate(texts)), 400)


@pytest.mark.parametrize("seed, length, rows", [(1, 40, 20_000), (2, 40, 3), (3, 64, 20_000), (4, 100, 5), (5, 17, 20_000)])
def test_against_every_string(spark, seed, length, rows):
    data = list(enumerate(texts(seed)))
    docs = spark.createDataFrame([(i, t, 1) for i, t in data], "doc_id long, text string, start int").repartition(3)
    got = digest(without_repeats(docs, length, rows)).collect()
    assert sorted(map(tuple, got), key=repr) == brute(data, length)


def test_repeated_rows_and_null_ids_are_copies(spark):
    data = [(1, "abcdefgh" * 4 + "0123456789"), (1, "abcdefgh" * 4 + "0123456789"), (None, "q" * 9), (2, "another text that is here once 1"), (None, "another text that is here once 2")]
    got = digest(without_repeats(spark.createDataFrame(data, "doc_id long, text string"), 20)).collect()
    assert sorted(map(tuple, got), key=repr) == brute(data, 20)


def test_empty_table(spark):
    assert without_repeats(spark.createDataFrame([], "doc_id long, text string"), 40).count() == 0
