"""Alignment of two tokenizations against a direct computation over whole texts."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict
from functools import cache

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from qaloom.llm import alignment
from qaloom.llm.alignment import Aligner, Tokens, aligned, byte_side, chunks, compose, fragment, piece_side

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@cache
def sides():
    return byte_side(open(BYTES, encoding="utf-8").read()), piece_side(open(PIECES, "rb").read())


@cache
def libraries():
    a = Tokenizer.from_file(BYTES)
    a.encode_special_tokens = True
    a.no_truncation()
    a.no_padding()
    return a, sentencepiece.SentencePieceProcessor(model_file=PIECES)


def groups(text):
    """[(ids of A, ids of B)] by the libraries, or [] for a text without tokens."""
    if not text:
        return []
    a, b = libraries()
    ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    tables = [s.tokens for s in sides()]
    if any(b"".join(t[i] for i in x) != (" " + text).encode() for t, x in zip(tables, ids)):
        return []
    ends = [np.cumsum([len(t[i]) for i in x]).tolist() for t, x in zip(tables, ids)]
    out, i, j = [], 0, 0
    for cut in sorted(set(ends[0]) & set(ends[1])):
        k, m = ends[0].index(cut, i) + 1, ends[1].index(cut, j) + 1
        out.append((ids[0][i:k], ids[1][j:m]))
        i, j = k, m
    return out


def expected(rows):
    linked = {n: Counter((x, y) for a, b in groups(text) for x in a for y in b) for n, (_, text) in enumerate(rows)}
    counts = Counter(pair for pairs in linked.values() for pair in pairs)
    highest = defaultdict(int)
    for (x, _), n in counts.items():
        highest[x] = max(highest[x], n)
    out = []
    for n, (key, text) in enumerate(rows):
        g = groups(text)
        shown = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        out.append((
            key, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(linked[n].values()),
            sum(t for p, t in linked[n].items() if counts[p] == highest[p[0]]), sum(t * counts[p] for p, t in linked[n].items()),
            hashlib.sha256(shown.encode()).hexdigest() if g else "",
        ))
    return sorted(out, key=repr)


def check(spark, rows, **options):
    docs = spark.createDataFrame([(*r, "c", 1) for r in rows], "doc_id long, text string, uid string, pair int").repartition(3)
    got = sorted((tuple(r) for r in aligned(docs, BYTES, PIECES, **options).collect()), key=repr)
    assert got == expected(rows)


def texts(n, seed):
    draw = random.Random(seed)
    pool = [*"abe st.,'!\n\t  ", "the ", "tion", "é", "日本語", "🙂", " ", "　", " ", "<|endoftext|>", "<s>", "'ll ", "  ", "\r\n", "42"]
    return ["".join(draw.choices(pool, k=draw.randint(1, 120))) for _ in range(n)]


EDGE = ["", None, " ", "  ", "a", "▁", "x▁ y", "<unk> </s>", "a\x00b", "﻿bom", "é", "<0x41>", "\n\n\n", " lead", "trail "]


def test_whole_and_cut_texts_agree_with_a_direct_computation(spark):
    rows = list(enumerate(EDGE + texts(60, 1)))
    check(spark, rows)
    check(spark, rows, chunk=16, fan=2)
    check(spark, rows, chunk=7, fan=3)


def test_nulls_and_repeated_rows(spark):
    check(spark, [(1, "the end"), (1, "the end"), (None, "the end of it"), (None, None), (2, "")], chunk=6)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id string, text string")
    assert aligned(docs, BYTES, PIECES).collect() == []


def test_a_very_long_word_and_a_very_long_text(spark):
    draw = random.Random(4)
    word = "".join(draw.choices("abcdefgh", k=60_000))
    prose = " ".join("".join(draw.choices("etaoin", k=draw.randint(1, 9))) for _ in range(30_000))
    check(spark, [(1, word), (2, prose), (3, "a" * 100_000), (4, prose + word)], chunk=4096)


def test_wide_groups_are_counted_before_they_are_paired(spark, monkeypatch):
    monkeypatch.setattr(alignment, "WIDE", 0)
    a = Aligner(*sides()).whole(texts(20, 2))
    monkeypatch.setattr(alignment, "WIDE", 1 << 40)
    b = Aligner(*sides()).whole(texts(20, 2))
    assert all(np.array_equal(a[k], b[k]) for k in ("pairs", "times", "split", "n_links"))


def test_counts_join_without_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr("qaloom.lineage.BROADCAST_ROWS", 0)
    check(spark, list(enumerate(texts(10, 3))))


def test_ids_are_those_of_the_libraries():
    a, b = libraries()
    for text in texts(400, 5) + [t for t in EDGE if t]:
        assert sides()[0].encode([" " + text])[0].tolist() == a.encode(" " + text, add_special_tokens=False).ids
        assert sides()[1].encode([" " + text])[0].tolist() == b.encode(text)


@pytest.mark.parametrize("size", [1, 5, 30])
def test_tokens_of_chunks_are_those_of_the_text(size):
    for text in texts(100, size):
        text = " " + text
        pieces = list(chunks(text, tuple(s.cut for s in sides()), size))
        for k, side in enumerate(sides()):
            parts = [text[s[2 * k] : s[2 * k + 1]] for _, _, s in pieces]
            assert "".join(parts) == text
            assert np.concatenate(side.encode([p for p in parts if p])).tolist() == side.encode([text])[0].tolist()
        assert [byte for _, byte, _ in pieces] == [len(text[: min(s)].encode()) for _, _, s in pieces]


def side_of(lengths, at):
    ends = np.cumsum(np.array(lengths, np.int64))
    tokens = Tokens(np.arange(len(ends)), ends)
    places = [0, *at, len(ends)]
    return tokens, [Tokens(tokens.ids[i:j], tokens.ends[i:j]) for i, j in zip(places, places[1:])]


def folded(parts, bracket):
    """Composed in the order that ``bracket`` draws; all groups as sorted (cut, a ids, b ids)."""
    found = []

    def keep(closed):
        a, b, cuts = closed
        low = -1
        for cut in cuts.tolist():
            low_a = a.between(low, cut) if low >= 0 else a.between(-1, cut)
            low_b = b.between(low, cut) if low >= 0 else b.between(-1, cut)
            found.append((cut, low_a.ids.tolist(), low_b.ids.tolist()))
            low = cut

    line = []
    for a, b in parts:
        piece, closed = fragment(a, b)
        keep(closed)
        line.append(piece)
    while len(line) > 1:
        i = bracket.randrange(len(line) - 1)
        piece, closed = compose(line[i], line[i + 1])
        keep(closed)
        line[i : i + 2] = [piece]
    return line[0], sorted(found)


@settings(max_examples=200, deadline=None)
@given(st.data())
def test_composition_is_associative_and_whole(data):
    """Any cutting of the two token rows, the two sides at different places, in any bracketing."""
    lengths = [data.draw(st.lists(st.integers(1, 4), min_size=1, max_size=30)) for _ in range(2)]
    gap = sum(lengths[0]) - sum(lengths[1])
    if gap:
        lengths[gap > 0].append(abs(gap))
    n = data.draw(st.integers(0, 5))
    at = [sorted(data.draw(st.lists(st.integers(0, len(x)), min_size=n, max_size=n))) for x in lengths]
    (whole_a, a), (whole_b, b) = side_of(lengths[0], at[0]), side_of(lengths[1], at[1])
    want_piece, want = folded([(whole_a, whole_b)], random.Random(0))
    for seed in range(3):
        piece, got = folded(list(zip(a, b)), random.Random(seed))
        assert got == want
        assert piece.cut == want_piece.cut
        for mine, other in zip((*piece.head, *piece.tail), (*want_piece.head, *want_piece.tail)):
            assert mine.ids.tolist() == other.ids.tolist() and mine.ends.tolist() == other.ends.tolist()
