"""Greedy tiles against a direct search, and leaks that must be found."""

from __future__ import annotations

import random

from qaloom.llm.tiling import annotate, keep_clean, report, tiles


def brute_tiles(pattern, text, least):
    free_p, free_t, found = [True] * len(pattern), [True] * len(text), []
    while True:
        best = None
        for p in range(len(pattern)):
            for t in range(len(text)):
                k = 0
                while p + k < len(pattern) and t + k < len(text) and free_p[p + k] and free_t[t + k] and pattern[p + k] == text[t + k]:
                    k += 1
                if k >= least and (best is None or k > best[0]):
                    best = (k, p, t)
        if best is None:
            return found
        found.append(best)
        for j in range(best[0]):
            free_p[best[1] + j] = free_t[best[2] + j] = False


def test_tiles_are_the_greedy_ones():
    draw = random.Random(6)
    for _ in range(150):
        letters = draw.choice(["ab", "abcd", "abcdefgh"])
        pattern = [ord(draw.choice(letters)) for _ in range(draw.randint(0, 25))]
        text = [ord(draw.choice(letters)) for _ in range(draw.randint(0, 60))]
        assert tiles(pattern, text, 2) == brute_tiles(pattern, text, 2), (pattern, text)


def words(draw, n):
    return ["".join(draw.choice("abcdefghé") for _ in range(draw.randint(2, 8))) for _ in range(n)]


def fixture(spark):
    draw = random.Random(8)
    items = [words(draw, n) for n in (40, 25, 15, 60)] + [["only", "three", "words"]]
    pad = lambda n: " ".join(words(draw, n))
    whole, w = " ".join(items[0]), items[3]
    swapped = w[40:60] + words(draw, 6) + w[0:20] + words(draw, 3) + w[20:40]
    edited = [x if k % 20 else "changed" for k, x in enumerate(items[0])]
    docs = [
        (0, None), (1, ""), (2, pad(300)),
        (3, f"{pad(50)} {whole.upper()}! {pad(50)}"),
        (4, f"{pad(20)}\n{' '.join(swapped)}"),
        (5, f"{pad(20)}, {', '.join(edited)}"),
        (6, f"{pad(30)} {' '.join(items[0][:12])} {pad(30)}"),
        (7, f"say Only -- three\nwords {pad(9)}"),
        (8, f"{' '.join(items[1])} {pad(5)} {' '.join(items[2])}"),
        (9, pad(60_000) + " " + whole + " " + pad(10)),
        (3, f"{whole}"),
    ]
    item_rows = [(i, " ".join(x)) for i, x in enumerate(items)] + [(10, None), (11, ""), (12, " ".join(items[2])), (None, pad(20))]
    return (
        spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, leaks string"),
        spark.createDataFrame(item_rows, "item_id long, text string"),
    )


def test_leaks(spark):
    docs, items = fixture(spark)
    got = {}
    for r in report(docs, items).collect():
        got.setdefault(r.doc_id, []).append((r.contaminated, sorted(r.item_ids)))
    assert got == {
        0: [(False, [])], 1: [(False, [])], 2: [(False, [])], 3: [(True, [0])] * 2, 4: [(True, [3])], 5: [(True, [0])],
        6: [(False, [])], 7: [(True, [4])], 8: [(True, [1, 2, 12])], 9: [(True, [0])],
    }


def test_blocks_of_items_change_nothing(spark):
    docs, items = fixture(spark)
    plain = docs.drop("leaks")
    one = {(r.doc_id, r.text): sorted(map(tuple, r.leaks)) for r in annotate(plain, items).collect()}
    many = {(r.doc_id, r.text): sorted(map(tuple, r.leaks)) for r in annotate(plain, items, block_seeds=30).collect()}
    assert one == many


def test_clean_documents_stay_as_they_are(spark):
    docs, items = fixture(spark)
    kept = keep_clean(docs, items)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [0, 1, 2, 6]
    assert keep_clean(docs.limit(0), items).count() == 0 and keep_clean(docs, items.limit(0)).count() == docs.count()


def test_short_runs_in_any_order_and_edited_items_leak(spark):
    draw = random.Random(12)
    items, docs = [], []
    for i in range(180):
        own = words(draw, 40)
        items.append((i, " ".join(own)))
        if i < 120:  # runs of three or four words in another order
            size = 3 if i < 60 else 4
            runs = [own[k : k + size] for k in range(0, 40, size)]
            draw.shuffle(runs)
            own = [w for run in runs for w in run]
        else:  # coverage is exactly 0.8
            own = [w if k % 5 else "changed" for k, w in enumerate(own)]
        docs.append((i, " ".join(words(draw, 30) + own + words(draw, 30))))
    rows = report(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {r.doc_id: list(r.item_ids) for r in rows.collect()}
    assert got == {i: [i] for i in range(180)}


def test_runs_scattered_over_a_long_text_are_no_leak(spark):
    draw = random.Random(13)
    item = words(draw, 40)
    runs = [item[k : k + 4] for k in range(0, 40, 4)]
    scattered = [w for run in runs for w in run + words(draw, 100)]
    half = item[:16] + words(draw, 500)
    docs = [(1, " ".join(scattered)), (2, " ".join(half)), (3, " ".join(words(draw, 20) + item[20:] + words(draw, 900) + item[:20]))]
    rows = report(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, " ".join(item))], "item_id long, text string"))
    assert {r.doc_id: list(r.item_ids) for r in rows.collect()} == {1: [], 2: [], 3: [7]}


def test_whole_documents_against_brute_force(spark):
    """Tiling each whole text with each item: with texts of at most twice an item's length nothing is far apart."""
    draw = random.Random(14)
    vocabulary = words(draw, 12)
    items = [(i, " ".join(draw.choice(vocabulary) for _ in range(draw.choice([1, 2, 3, 4, 9, 30])))) for i in range(12)] + [(12, "")]
    docs = []
    for i in range(60):
        own = draw.choice(items)[1].split()
        cut = draw.randrange(len(own) + 1)
        text = own[cut:] + own[:cut]
        for _ in range(draw.choice([0, 1, 3])):
            if text:
                text[draw.randrange(len(text))] = draw.choice(vocabulary)
        docs.append((i, " ".join(text + [draw.choice(vocabulary) for _ in range(draw.choice([0, 4]))])))
    rows = report(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {r.doc_id: sorted(r.item_ids) for r in rows.collect()}
    want = {}
    for i, text in docs:
        code = {w: k for k, w in enumerate(vocabulary)}
        t = [code[w] for w in text.split()]
        want[i] = []
        for k, item in items:
            p = [code[w] for w in item.split()]
            if p and sum(x[0] for x in brute_tiles(p, t, min(3, len(p)))) >= 0.8 * len(p):
                want[i].append(k)
    assert got == want and any(want.values()) and not all(len(x) == 1 for x in want.values())
