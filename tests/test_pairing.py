from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

from qaloom.operators import pairing, split
from qaloom.operators.dense import hash_index, range_index
from qaloom.operators.stats import category_pool


def digest(key, seed):
    return hashlib.md5(f"{key}|{seed}".encode()).hexdigest()


def pools(rows, seed, skip_first=True):
    """Brute force: rows of each category in hash order, without the first one."""
    groups = defaultdict(list)
    for r in sorted(rows, key=lambda r: r["row_id"]):
        groups[r["category"]].append(r)
    return {
        c: sorted(g[1:] if skip_first else g, key=lambda r: (digest(r["row_id"], seed), r["row_id"]))
        for c, g in groups.items()
    }


def test_hash_index_is_row_number(spark, qa):
    for skip_first in (True, False):
        expected = {
            r["row_id"]: (i, len(pool))
            for pool in pools(qa.collect(), 3, skip_first).values()
            for i, r in enumerate(pool)
        }
        got = hash_index(qa, "category", "row_id", 3, skip_first).where("idx is not null")
        assert {r["row_id"]: (r["idx"], r["pool_n"]) for r in got.collect()} == expected


def test_missing_category_is_a_category(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, "a")], "row_id long, category string")
    got = hash_index(df, "category", "row_id", 0).collect()
    assert sorted(r["idx"] for r in got if r["category"] is None) == [0, 1]


def test_range_index(spark):
    ids = [5, 7, 100, 101, 2_000_000, 9_000_000_000]
    df = spark.createDataFrame([(i,) for i in reversed(ids)], "row_id long")
    got = {r["row_id"]: r["position"] for r in range_index(df, "row_id", width=100).collect()}
    assert got == {v: i for i, v in enumerate(ids)}


def test_pool_sizes(spark):
    rows = [(1, "one"), (2, "two"), (3, "two"), (4, "three"), (5, "three"), (6, "three")]
    df = spark.createDataFrame(rows, "row_id long, category string")
    sizes = Counter(r["category"] for r in category_pool(df, 1).collect())
    assert sizes == {"two": 1, "three": 2}


def test_partner(spark, qa):
    pairs = pairing.category_partner(qa, 5).collect()
    by_id = {r["row_id"]: r for r in qa.collect()}
    firsts = {}
    for i in sorted(by_id):
        firsts.setdefault(by_id[i]["category"], i)
    # Every row but the one whose category has an empty pool.
    assert sorted(p["row_id"] for p in pairs) == list(range(120))
    for p in pairs:
        own, other = by_id[p["row_id"]], by_id[p["partner_id"]]
        assert own["category"] == other["category"] == p["category"]
        assert (p["q1"], p["a1"], p["q2"], p["a2"]) == (
            own["input"], own["output"], other["input"], other["output"]
        )
        assert p["partner_id"] != firsts[p["category"]]


def test_partner_does_not_depend_on_partitions(spark, qa):
    one = pairing.category_partner(qa.coalesce(1), 5)
    many = pairing.category_partner(qa.repartition(13), 5)
    key = ("row_id", "draw_no", "partner_id")
    assert sorted(one.select(*key).collect()) == sorted(many.select(*key).collect())


def test_minority_partner(spark, qa):
    pairs = pairing.minority_partner(qa, 5, ["b", "single"], repeats=3).collect()
    assert {p["category"] for p in pairs} == {"b"}
    counts = Counter(p["row_id"] for p in pairs)
    assert set(counts.values()) == {3} and len(counts) == 20


def test_sample_two(spark, qa):
    got = {r["category"]: r for r in pairing.category_sample_two(qa, 9).collect()}
    expected = pools(qa.collect(), "9|sample")
    assert set(got) == {c for c, p in expected.items() if len(p) >= 2} == {"a", "b", "c", "d"}
    for c, r in got.items():
        assert [r["row_id_1"], r["row_id_2"]] == [x["row_id"] for x in expected[c][:2]]
    other = pairing.category_sample_two(qa, 10).collect()
    assert any(got[r["category"]]["row_id_1"] != r["row_id_1"] for r in other)


def test_negatives(spark, qa):
    more = qa.union(spark.createDataFrame([(500, "q", "a", "unknown")], qa.schema))
    listed = ["a", "b", "c", "d"]
    rows = pairing.negative_pairs(more, 2, listed, n=200).collect()
    assert sorted(r["draw_id"] for r in rows) == list(range(200))
    by_id = {r["row_id"]: r for r in more.collect()}
    for r in rows:
        assert r["input_category"] != r["output_category"]
        assert by_id[r["input_row"]]["input"] == r["input"]
        assert by_id[r["output_row"]]["output"] == r["output"]
        assert by_id[r["input_row"]]["category"] == r["input_category"]
        assert by_id[r["output_row"]]["category"] == r["output_category"]
        assert (r["category"], r["average_score"]) == ("부정라벨링", 2.0)
    assert {r["input_category"] for r in rows} == set(listed)


def test_negatives_large_draw_and_empty_category(spark, qa, monkeypatch):
    usual = pairing.negative_pairs(qa, 2, ["a", "b", "none"], n=100).collect()
    assert 0 < len(usual) < 100
    monkeypatch.setattr(pairing, "BROADCAST_ROWS", 10)
    shuffled = pairing.negative_pairs(qa, 2, ["a", "b", "none"], n=100).collect()
    assert sorted(usual) == sorted(shuffled)


def test_folds(spark, qa):
    for k in (20, 7):
        rows = split.stratified_folds(qa, 4, k).collect()
        assert sorted(r["row_id"] for r in rows) == list(range(121))
        assert all(r["is_eval"] == (r["fold"] == 0) for r in rows)
        sizes = Counter(r["fold"] for r in rows)
        assert max(sizes.values()) - min(sizes[f] for f in range(k)) <= 1
        for category in "abcd":
            per_fold = Counter(r["fold"] for r in rows if r["category"] == category)
            counts = [per_fold.get(f, 0) for f in range(k)]
            assert max(counts) - min(counts) <= 1


def test_folds_do_not_depend_on_partitions(spark, qa):
    one = split.stratified_folds(qa.coalesce(1), 4).select("row_id", "fold")
    many = split.stratified_folds(qa.repartition(8), 4).select("row_id", "fold")
    assert sorted(one.collect()) == sorted(many.collect())


def test_split_sides(spark, qa):
    train, held_out = split.train_eval_split(split.stratified_folds(qa, 4))
    assert train.columns == qa.columns
    assert sorted(train.union(held_out).collect()) == sorted(qa.collect())
    assert held_out.count() in (6, 7)
