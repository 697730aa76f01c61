"""Mined collocations against a direct count of every phrase."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from qaloom.llm.collocations import frequent_phrases, mined, regrouped, wide_batches

SCHEMA = "doc_id long, text string, lang string, at int, words string"


def split(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [re.findall(r"[^\x20\x09]+", piece) for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered)]


def expected(rows, least, longest=5, top=2000, cover=100):
    n, f = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in split(text):
            n[lang] += len(piece)
            for size in range(1, longest + 1):
                for i in range(len(piece) - size + 1):
                    f[lang, tuple(piece[i : i + size])] += 1
    candidates = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    gone = set()
    for (lang, phrase), a in candidates.items():
        for i in range(len(phrase)):
            for j in range(i + 2, len(phrase) + 1):
                part = (lang, phrase[i:j])
                if part[1] != phrase and 100 * a >= cover * candidates[part]:
                    gone.add(part)
    out = {}
    for (lang, phrase), a in candidates.items():
        if (lang, phrase) in gone:
            continue
        cuts = []
        for k in range(1, len(phrase)):
            l, r = f[lang, phrase[:k]], f[lang, phrase[k:]]
            cuts.append((1000 * a * n[lang] // (l * r), k, l, r))
        score, _, l, r = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(phrase).encode(), l, r))
    return sorted(
        (lang, rank, phrase.decode(), -a, l, r, n[lang], -score)
        for lang, found in out.items()
        for rank, (score, a, phrase, l, r) in enumerate(sorted(found)[:top], 1)
    )


def check(spark, rows, **options):
    docs = spark.createDataFrame([(i, t, g, 0, "c") for i, (t, g) in enumerate(rows)], SCHEMA).repartition(3)
    got = sorted(tuple(r) for r in mined(docs, **options).collect())
    assert got == expected([(i, t, g) for i, (t, g) in enumerate(rows)], **options)
    return got


def sample(seed, n=300):
    draw = random.Random(seed)
    vocabulary = ["the", "of", "New", "york", "city", "é", "Été", "a-b", "x", "日本", "(q)", *(f"w{i}" for i in range(20))]
    phrases = ["New York City", "of the", "a-b x 日本 é (q)", "w1 w1 w1", "w2 w3 w2 w3"]
    ends = [" ", " ", " ", "  ", "\t", ", ", ".\n", "; ", "?", "\x0b"]
    rows = []
    for _ in range(n):
        parts = [draw.choice(phrases if draw.random() < 0.3 else vocabulary) + draw.choice(ends) for _ in range(draw.randint(0, 40))]
        rows.append(("".join(parts), draw.choice(["en", "en", "en", "fr", None, "und"])))
    return rows


def test_against_a_direct_count(spark):
    assert len(check(spark, sample(1), least=5)) > 100


def test_top_cover_and_length(spark):
    check(spark, sample(2), least=4, top=3)
    check(spark, sample(2), least=4, cover=60)
    check(spark, sample(2), least=4, longest=3)


def test_groups_join_without_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr("qaloom.lineage.BROADCAST_ROWS", 0)
    check(spark, sample(3, 150), least=4)


def test_nulls_blanks_repeated_rows_and_long_texts(spark):
    rows = [(None, "en"), ("", "en"), (" \t\n.,", None), ("a b", "en"), ("a b", "en"), ("a b", "und"), ("a b a b", None)]
    check(spark, rows, least=2)
    check(spark, [("k l m n " * 30_000, "en"), ("z" * 300_000, "en"), ("k l, m n", "en")], least=3)


def test_empty_table_and_no_candidates(spark):
    assert mined(spark.createDataFrame([], "text string, lang string")).collect() == []
    assert mined(spark.createDataFrame([("one two three", "en")], "text string, lang string")).collect() == []


def test_scores_beyond_64_bits_are_exact(spark):
    from qaloom.llm import collocations

    a, n, l, r = 3 * 10**9, 7 * 10**12, 4 * 10**9, 5 * 10**9
    found = spark.createDataFrame([(0, "en", ["x"], l, None, None), (1, "en", ["y"], r, None, None)], "gid long, lang string, words array<string>, a long, left long, right long")
    pairs = spark.createDataFrame([(0, "en", ["x", "y"], a, 0, 1)], found.schema)
    totals = spark.createDataFrame([("en", n)], "lang string, n long")
    with pytest.MonkeyPatch.context() as m:
        m.setattr(collocations, "frequent_phrases", lambda *_: (totals, [found, pairs]))
        assert mined(pairs)[["score"]].collect()[0][0] == 1000 * a * n // (l * r)


def test_relations_hold_every_occurrence_of_frequent_phrases(spark):
    rows = [(t, g) for t, g in sample(4, 100)]
    docs = spark.createDataFrame(rows, "text string, lang string")
    _, phrases = frequent_phrases(docs, least=4)
    got = {(r.lang, tuple(r.words)): r.a for p in phrases for r in p.collect()}
    counts = Counter()
    for text, lang in rows:
        for piece in split(text):
            for size in range(1, 6):
                counts.update((lang or "und", tuple(piece[i : i + size])) for i in range(len(piece) - size + 1))
    assert got == {p: a for p, a in counts.items() if a >= 4}


def test_texts_that_reach_over_batches_stay_whole():
    part = np.repeat([1, 2, 5, 6], [3, 70, 1, 4]).astype(np.int64)
    at, gid = np.arange(len(part), dtype=np.int32), np.arange(len(part), dtype=np.int64)
    for step in (1, 2, 7, 100):
        batches = [pa.RecordBatch.from_arrays([pa.array(x[i : i + step]) for x in (part, at, gid)], ["part", "at", "gid"]) for i in range(0, len(part), step)]
        rows = [r for b in regrouped(iter(batches)) for r in b.to_pylist()]
        assert [r["part"] for r in rows] == [1, 2, 5, 6]
        assert [x for r in rows for x in r["at"]] == at.tolist()


def test_batches_are_bounded_by_bytes_and_put_back(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    rows = spark.range(0, 4000, 1, 1).selectExpr("repeat('x', 10000) t")
    with wide_batches(spark, 3000, 1 << 20):
        got = [r.n for r in rows.mapInArrow(sizes, "n long").collect()]
    assert sum(got) == 4000 and max(got) < 250
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
