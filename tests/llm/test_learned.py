"""Held-out accuracy of the trained operators, exact counts, and odd inputs."""

from __future__ import annotations

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from qaloom.llm import langmix, quality, toxicity
from qaloom.llm.catalog import QUERIES

SF = "/root/testdata/sf0.1"
SMALL = "/root/testdata/sf0.001"
ODD = [(0, None), (1, ""), (2, " \n\t"), (3, "!!! 123 ***"), (4, "word"), (None, "some text here"), (6, "a. " * 60_000), (4, "word")]


def odd(spark):
    return spark.createDataFrame([(i, t, "en", 1) for i, t in ODD], "doc_id long, text string, lang string, score int")


def fold(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def test_toxicity_on_the_held_out_third(spark):
    rows = QUERIES["op2_toxicity"](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    assert all(r.held_out == fold(r.doc_id) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    held = [r for r in rows if r.held_out]
    toxic, clean = [r for r in held if r.toxic], [r for r in held if not r.toxic]
    assert np.mean([r.predicted for r in toxic]) > 0.8
    assert np.mean([r.predicted for r in clean]) < 0.02
    assert all(r.offending for r in toxic if r.score > 0.999)
    assert sum(len(r.offending) for r in clean) < 0.1 * len(clean)


def test_offending_sentences_are_cut_at_their_ends(spark):
    model = toxicity.Model(*fitted())
    text = "All is well here. This one is vile, really vile! Fine again\nvile end"
    docs = spark.createDataFrame([(1, text, "t")], "doc_id long, text string, toxicity string")
    with pytest.raises(ValueError):
        toxicity.score(docs, model)
    found = toxicity.score(docs, model, "tox").first().tox
    assert [text.encode()[s.start : s.end].decode() for s in found.sentences] == ["This one is vile, really vile!", "vile end"]
    assert found.score > 0.9


def fitted():
    hashes, _, _, _ = toxicity.features(np.frombuffer(b"vile", np.uint8), np.array([0, 4]))
    return np.sort(hashes[0, :1]), np.array([14.0]), -8.0


def test_noisy_or_blames_the_sentence_that_explains_the_label():
    class Row:
        def __init__(self, toxic, bare, pairs):
            self.toxic, self.bare, self.pairs = toxic, bare, pairs

    draw = random.Random(1)
    rows = []
    for i in range(300):
        toxic = i % 4 == 0
        pairs = [x for s in range(3) for x in (s, draw.choice([1, 2]))] + ([3, 0] if toxic else [])
        rows.append(Row(toxic, 5, pairs))
    weights, bias = toxicity.fit_noisy_or(rows, 3)
    assert weights[0] + bias > 1 and max(weights[1:]) + bias < -3


def base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen: dict[tuple, list[int]] = {}
    for k in range(len(words) - 2):
        seen.setdefault(tuple(words[k : k + 3]), []).append(k)
    covered = {k + j for places in seen.values() if len(places) > 1 for k in places for j in range(3)}
    lines, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in lines
            lines.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def test_quality_counts_and_held_out_verdicts(spark):
    rows = QUERIES["op6_quality"](spark, SF)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    right = []
    for r in rows.collect():
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        if r.doc_id % 10 == 0:
            assert got == base(texts[r.doc_id])
        failed = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        assert r.base_failed == failed and not (r.kept and failed)
        if r.doc_id in labels and fold(r.doc_id) and not failed:
            right.append(r.kept == bool(labels[r.doc_id]))
    assert np.mean(right) > 0.95


def test_quality_of_odd_texts(spark):
    extra = [(10, "a b c\n\na b c\r\na b c\n \nx|y  é<z> a b c"), (11, "one two three four " * 20), (12, "Ünï cödé\x0bwörds\n" * 3)]
    docs = odd(spark).union(spark.createDataFrame([(i, t, "en", 1) for i, t in extra], odd(spark).schema)).repartition(2)
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    got = quality.verdicts(docs, labels.limit(0)).collect()
    want = sorted([(i, *base(t)) for i, t in [*ODD, *extra]], key=repr)
    assert sorted([(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got], key=repr) == want
    assert quality.verdicts(docs.limit(0), labels).count() == 0


def test_language_on_the_held_out_third(spark):
    rows = QUERIES["op8_langmix"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == fold(r.doc_id) and 0 <= r.score <= 1 for r in rows)
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.99


def test_mixtures_and_odd_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(1500)
    by_lang = {r.lang: r.text[:1500] for r in docs.where("length(text) > 1500").collect()}
    model = langmix.fit(docs)
    mixed = spark.createDataFrame([(1, by_lang["en"] + "\n" + by_lang["de"]), (2, by_lang["fr"])], "doc_id long, text string")
    one, two = langmix.identify(mixed, model).orderBy("doc_id").collect()
    assert {x.lang for x in one.languages} == {"en", "de"} and all(0.3 < x.share < 0.7 for x in one.languages)
    assert [x.lang for x in two.languages] == ["fr"] and two.score == pytest.approx(1, abs=1e-6)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langmix.identify(odd(spark), model).collect()}
    assert all(got[i] == ("und", 0.0) for i in (0, 1, 2, 3)) and got[4][0] != "und"
    blind = langmix.identify(odd(spark), langmix.fit(odd(spark).withColumn("lang", F.lit(None).cast("string"))))
    assert {r.lang_pred for r in blind.collect()} == {"und"}
    assert langmix.predictions(odd(spark).limit(0)).count() == 0


def test_toxicity_of_odd_texts(spark):
    labels = spark.createDataFrame([(4, 1), (6, 0), (None, 1), (99, None)], "doc_id long, toxic int")
    for own in (labels, labels.limit(0)):
        got = toxicity.predictions(odd(spark), own).collect()
        assert len(got) == len(ODD) and all(r.predicted == 0 for r in got if r.doc_id in (0, 1, 2))
    assert toxicity.predictions(odd(spark).limit(0), labels).count() == 0
    assert toxicity.keep_clean(odd(spark), labels).columns == odd(spark).columns
