"""Tokens and texts against the tokenizers library."""

from __future__ import annotations

import hashlib
import random
from array import array

import pytest
from tokenizers import Tokenizer

from qaloom.llm import bpe
from qaloom.llm.catalog import tokenizer_path

PATH = tokenizer_path()


@pytest.fixture(scope="module")
def vocabulary():
    with open(PATH, encoding="utf-8") as f:
        return bpe.Vocabulary(f.read())


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def texts():
    draw = random.Random(9)
    pick = lambda chars, n: "".join(draw.choice(chars) for _ in range(n))
    return [
        "", " ", "  ", "\n\n x", "I'll've don't 're", "x<|endoftext|>y  z", "<|endoftext|>", "日本語" * 3000, "ab" * 6000,
        " " * 9000, "a" * 20_000, "-=" * 7000, "é" * 9000 + "  " + "'re" * 4000, "\r\n\t a", "🙂" * 999, "a  b　c",
        pick("abcdetrhin", 30_000), pick(" '\nrelvd9aé日!", 100_000), *[pick(" ab'c\n1é", n) for n in range(1, 80)],
    ]


def test_encode_and_decode_equal_the_library(vocabulary, library):
    for text in texts():
        want = library.encode(text, add_special_tokens=False).ids
        ids = list(vocabulary.encode(text))
        assert ids == want, text[:60]
        assert "".join(vocabulary.decoded(ids)) == library.decode(want, skip_special_tokens=False)


def test_any_ids_decode_as_the_library_decodes(vocabulary, library):
    draw = random.Random(1)
    for _ in range(60):
        ids = [draw.choice([draw.randrange(50_257), draw.randrange(256)]) for _ in range(draw.randint(0, 60))]
        assert "".join(vocabulary.decoded(ids, step=3)) == library.decode(ids, skip_special_tokens=False)


def test_a_window_of_the_lookahead_is_enough(vocabulary, monkeypatch):
    """The smallest window past the lookahead gives what the whole text gives."""
    monkeypatch.setattr(bpe, "WINDOW", 8)
    draw = random.Random(2)
    for chars in ("ab", "the", "abcdefghij", " -=", "日本"):
        data = "".join(draw.choice(chars) for _ in range(1500)).encode()
        assert vocabulary.tokens(data) == vocabulary.merged([vocabulary.byte_ids[b] for b in data])
    assert 1 < vocabulary.lookahead < 5000


def test_small_caches_change_nothing(vocabulary, library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 3)
    with open(PATH, encoding="utf-8") as f:
        own = bpe.Vocabulary(f.read())
    text = "one two three four one two  five.six one\n" * 20
    assert list(own.encode(text)) == library.encode(text, add_special_tokens=False).ids


def test_digests(spark, library):
    rows = [(i, t, 1) for i, t in enumerate([None, *texts()[:12], "same", "same"])] + [(None, "x", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = {(r.doc_id): tuple(r) for r in bpe.digests(docs, PATH).collect()}
    for i, t, _ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want = (i, len(ids), hashlib.sha256(array("I", ids).tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
        assert got[i] == want
    both = bpe.decode(bpe.encode(docs, PATH), PATH).collect()
    assert all(r.decoded == (r.text or "") for r in both)
    assert bpe.digests(docs.limit(0), PATH).count() == 0
    with pytest.raises(ValueError):
        bpe.encode(docs, PATH, out="TEXT")
