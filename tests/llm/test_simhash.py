"""SimHash groups against a direct computation over all pairs."""

from __future__ import annotations

import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from qaloom.llm.components import components
from qaloom.llm.simhash import forest, near_duplicates, shard_links


def fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    shingles = [" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(values):
    """Least id reachable per id, over all pairs within three bits."""
    label = {i: i for i in values}
    changed = True
    while changed:
        changed = False
        for i, a in values.items():
            for j, b in values.items():
                if (a ^ b).bit_count() <= 3 and label[j] < label[i]:
                    label[i], changed = label[j], True
    return label


def check(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string, component_id string")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in near_duplicates(docs).collect()}
    prints = {i: fingerprint(t) for i, t, *_ in rows}
    want = groups(prints)
    assert got == {i: (f"{prints[i]:016x}", want[i]) for i in prints}


def test_against_all_pairs(spark):
    draw = random.Random(3)
    vocabulary = ["".join(draw.choice("abcdeéß") for _ in range(draw.randint(1, 7))) for _ in range(300)]
    texts = [None, "", " \t\n", "One", "one", "two Words", "a b c", "A\tB\x0bC", "x" * 5000]
    for _ in range(40):
        words = draw.choices(vocabulary, k=draw.randint(20, 200))
        texts.append(" ".join(words))
        for _ in range(draw.randint(0, 3)):
            words[draw.randrange(len(words))] = draw.choice(vocabulary)
            texts.append("  ".join(words).title())
    draw.shuffle(texts)
    texts.append("word " * 40_000)
    check(spark, [(i, t, "clash", "clash") for i, t in enumerate(texts)])


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_links_join_exactly_the_pairs_in_reach(spark):
    draw = random.Random(5)
    values = {draw.getrandbits(64) for _ in range(60)}
    for value in list(values):
        for _ in range(6):
            for bit in draw.sample(range(64), draw.choice([1, 2, 3, 4])):
                value ^= 1 << bit
            values.add(value)
    values |= {0, 1, 7, 15, (1 << 64) - 1, (1 << 63) - 1}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    links = shard_links(spark.createDataFrame([(v,) for v in signed], "fp long"))
    assert links.where("bit_count(a ^ b) > 3 or a = b").count() == 0
    found = {r.node: r.root for r in components(links, "a", "b").collect()}
    want = groups({s: s % (1 << 64) for s in signed})
    by_label, by_root = {}, {}
    for s in signed:
        by_label.setdefault(want[s], set()).add(s)
        by_root.setdefault(found.get(s, s), set()).add(s)
    assert sorted(map(sorted, by_label.values())) == sorted(map(sorted, by_root.values()))


def test_a_dense_shard_hands_on_a_forest():
    values = [1 << a | 1 << b for a in range(40) for b in range(a)]
    assert len(forest(values, 3)) == len(values) - 1


@pytest.mark.parametrize("edges, want", [([], {}), ([(1, 1)], {}), ([(None, 2), (3, 2), (3, 2), (5, 3)], {3: 2, 5: 2})])
def test_components_of_odd_edges(spark, edges, want):
    df = spark.createDataFrame(edges, "x long, y long")
    assert {r.node: r.root for r in components(df, "x", "y").collect()} == want


def test_components_of_a_long_chain(spark):
    chain = spark.range(300).select(F.expr("(id * 7919) % 301").alias("x"), F.expr("((id + 1) * 7919) % 301").alias("y"))
    assert {r.root for r in components(chain, "x", "y").collect()} == {0}
