from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from qaloom.functions.vectors import Bounded, Nearest
from qaloom.operators import retrieval
from qaloom.operators.submission import positional_fallback_join

SCHEMA = "{} long, embedding array<float>"


def table(spark, vectors, name, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    rows = [(i, None if v is None else [float(x) for x in v]) for i, v in zip(ids, vectors)]
    return spark.createDataFrame(rows, SCHEMA.format(name))


def brute(queries, passages, k):
    hits = []
    for i, q in enumerate(queries):
        order = sorted(
            (float(((np.float64(np.float32(q)) - np.float64(np.float32(p))) ** 2).sum()), j)
            for j, p in enumerate(passages)
        )[:k]
        hits += [(i, r + 1, j, round(d, 9)) for r, (d, j) in enumerate(order)]
    return sorted(hits)


def rows(hits):
    return sorted((r["id"], r["rank"], r["doc_id"], round(r["distance"], 9)) for r in hits.collect())


VARIANTS = {
    "broadcast": lambda q, p, k: retrieval.knn_join(q, p, k),
    "over the bound": lambda q, p, k: retrieval.knn_join(q, p, k, query_bytes=1),
    "blocked": lambda q, p, k: retrieval.knn_join_blocked(q, p, k, 7, 11),
    "pruned": lambda q, p, k: retrieval.knn_join_pruned(q, p, k, 6, 9, 5),
    "coded": lambda q, p, k: retrieval.knn_join_approx(q, p, k),
    "coded in blocks": lambda q, p, k: retrieval.knn_join_approx(q, p, k, query_bytes=150),
}


@pytest.mark.parametrize("variant", VARIANTS)
def test_variants_equal_brute_force(spark, variant):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(5, 8)) * 10
    passages = np.concatenate([c + rng.normal(size=(20, 8)) for c in centres])
    # A third of all rows are copies of one vector, and some queries equal a passage.
    passages = np.concatenate([passages, np.repeat(passages[:1], 50, axis=0)]).astype(np.float32)
    queries = np.concatenate([passages[:3], passages[30:33] + 0.1, rng.normal(size=(10, 8))])
    got = VARIANTS[variant](
        table(spark, queries, "id"), table(spark, passages, "doc_id").repartition(3), 4
    )
    assert rows(got) == brute(queries, passages, 4)


@pytest.mark.parametrize("variant", VARIANTS)
def test_few_passages_and_missing_vectors(spark, variant):
    queries = [[0.0, 0.0], None, [5.0, 5.0]]
    passages = [[1.0, 0.0], None, [0.0, 1.0]]
    got = VARIANTS[variant](table(spark, queries, "id"), table(spark, passages, "doc_id"), 4)
    assert [r[:3] for r in rows(got)] == [(0, 1, 0), (0, 2, 2), (2, 1, 0), (2, 2, 2)]


@pytest.mark.parametrize("variant", VARIANTS)
def test_no_passages(spark, variant):
    got = VARIANTS[variant](table(spark, [[0.0, 0.0]], "id"), table(spark, [], "doc_id"), 4)
    assert rows(got) == []


@pytest.mark.parametrize("splits", [3, 40, 90])
def test_rows_of_the_last_merge_do_not_grow_with_the_splits(spark, splits, monkeypatch):
    monkeypatch.setattr(retrieval, "GROUPS", 5)
    monkeypatch.setattr(retrieval, "_search_tasks", lambda *_: splits)
    rng = np.random.default_rng(3)
    passages = rng.normal(size=(900, 4)).astype(np.float32)
    queries = rng.normal(size=(6, 4)).astype(np.float32)
    last = []
    original = retrieval.merged

    def counted(hits, k, parts):
        out = original(hits, k, parts)
        last.append((parts, out.groupBy("id").count().agg({"count": "max"}).first()[0]))
        return out

    monkeypatch.setattr(retrieval, "merged", counted)
    stored = table(spark, passages, "doc_id").repartition(splits)
    assert rows(retrieval.knn_join(table(spark, queries, "id"), stored, 4)) == brute(queries, passages, 4)
    assert rows(retrieval.knn_join_blocked(table(spark, queries, "id"), stored, 4, 3, 900 // splits)) == brute(queries, passages, 4)
    assert [n for _, n in last] == [min(splits, 5) * 4] * 2


def test_search_tasks_follow_bytes(spark, tmp_path):
    spark.range(1000).selectExpr("id AS doc_id", "array(1.0f, 2.0f) AS embedding").write.parquet(str(tmp_path / "v"))
    stored = spark.read.parquet(str(tmp_path / "v"))
    cores = spark.sparkContext.defaultParallelism
    assert retrieval._search_tasks(stored, 100) == cores
    # A size that nothing is known of counts as large; many hits ask for larger tasks.
    unknown = spark.sparkContext.parallelize([(1, [1.0])]).toDF("doc_id long, embedding array<float>")
    assert retrieval._search_tasks(unknown, 100) == 1 << 20
    few = 1 << 60
    assert retrieval._search_tasks(unknown, few) == cores


def test_grid_copies_the_fewest_rows(spark):
    for n, m, room in [(5, 5, 10), (7, 100, 20), (100, 7, 20), (1000, 1000, 64), (3, 10_000, 50), (10, 9, 2), (1, 1, 2)]:
        r, c = retrieval.grid(n, m, room)
        copies = n * c + m * r
        cost = lambda i: n * -(-m // (room - -(-n // i))) + m * i if room > -(-n // i) else None
        assert (r, c) == (1, 1) if n + m <= room else copies == min(x for i in range(1, n + 1) if (x := cost(i)) is not None)
        assert n + m <= room or -(-n // r) + -(-m // c) <= room
    queries = table(spark, np.zeros((30, 2)), "id")
    passages = table(spark, np.zeros((200, 2)), "doc_id")
    left, right = retrieval._grid_sides(queries, passages, 2, 5)
    assert (left.count(), right.count()) == (30 * 5, 200 * 2)
    square = 30 * 10 + 200 * 2  # two equal sides of 20 rows
    r, c = retrieval.grid(30, 200, 40)
    left, right = retrieval._grid_sides(queries, passages, r, c)
    assert left.count() + right.count() == 30 * c + 200 * r <= square


def test_recall_of_a_bounded_rerank(spark):
    rng = np.random.default_rng(4)
    passages = rng.normal(size=(400, 16)).astype(np.float32)
    queries = rng.normal(size=(10, 16)).astype(np.float32)
    asked, stored = table(spark, queries, "id"), table(spark, passages, "doc_id")
    codes, exact = retrieval.vector_codes(stored), retrieval.knn_join(asked, stored, 5)
    whole = retrieval.recall_of(retrieval.knn_join_approx(asked, stored, 5, codes), exact)
    assert {r.recall for r in whole.collect()} == {1.0}
    near = retrieval.recall_of(retrieval.knn_join_approx(asked, stored, 5, codes, rerank=6), exact).collect()
    assert sum(r.recall for r in near) / len(near) >= 0.9
    two = retrieval.recall_of(retrieval.knn_join_approx(asked, stored, 5, codes, rerank=2), exact).collect()
    assert {r.recall for r in two} == {0.4}


def test_codes_decide_nearly_all_passages(spark):
    """Full vectors are read for one passage in a hundred at most, copies included."""
    rng = np.random.default_rng(5)
    passages = np.concatenate([rng.normal(size=(3000, 24)), np.zeros((1500, 24))]).astype(np.float32)
    queries = np.concatenate([rng.normal(size=(5, 24)), np.zeros((1, 24))]).astype(np.float32)
    codes = retrieval.vector_codes(table(spark, passages, "doc_id").repartition(4))
    table_of_codes = codes.frame.toArrow()
    bounded = Bounded(queries.astype(np.float64), 4)
    for batch in table_of_codes.to_batches(max_chunksize=500):
        slack, same = (np.asarray(batch.column(c)) for c in ("slack", "same"))
        bounded.add(codes.points(batch.column("code")), slack, same, np.asarray(batch.column("doc_id")))
    row, *_ = bounded.rows()
    assert (np.bincount(row, minlength=6) <= 45).all() and (np.bincount(row, minlength=6) >= 4).all()
    assert codes.frame.agg({"slack": "max"}).first()[0] > 0


def test_pruning_visits_fewer_cells(spark):
    """Far clusters are not visited, so their rows never meet the question."""
    rng = np.random.default_rng(2)
    passages = np.concatenate([rng.normal(size=(50, 4)) + 1000 * c for c in range(8)])
    queries = rng.normal(size=(3, 4))
    hits = retrieval.knn_join_pruned(
        table(spark, queries, "id"), table(spark, passages, "doc_id"), 4, 64, 100, 100
    )
    assert rows(hits) == brute(queries, passages, 4)


def test_text_ids(spark):
    q = spark.createDataFrame([("T1", [0.0])], "id string, embedding array<float>")
    p = spark.createDataFrame(
        [("b", [1.0]), ("a", [1.0]), ("c", [9.0])], "doc_id string, embedding array<float>"
    )
    got = retrieval.knn_join(q, p, 2).orderBy("rank").collect()
    assert [(r["id"], r["doc_id"]) for r in got] == [("T1", "a"), ("T1", "b")]


def test_kernel_with_many_copies():
    """All vectors equal: the lowest ids win, whatever the batches."""
    nearest = Nearest(np.zeros((300, 3)), 4)
    ids = np.random.default_rng(0).permutation(5000)
    for start in range(0, 5000, 700):
        part = ids[start : start + 700]
        nearest.add(np.ones((len(part), 3)), part)
    for q in (0, 299):
        assert sorted(nearest.ids[nearest.row == q]) == [0, 1, 2, 3]


def test_width_mismatch():
    with pytest.raises(ValueError, match="components"):
        Nearest(np.zeros((1, 3)), 4).add(np.ones((1, 2)), np.array([0]))


def test_context_order(spark):
    hits = spark.createDataFrame(
        [("q", 2, 10), ("q", 1, 11), ("r", 1, 10)], "id string, rank int, doc_id long"
    )
    passages = spark.createDataFrame(
        [(10, "ten"), (11, "eleven"), (12, "never")], "doc_id long, page_content string"
    )
    got = {r["id"]: r["context"] for r in retrieval.join_context(hits, passages).collect()}
    assert got == {"q": "eleven\n\nten", "r": "ten"}


def test_positional_fallback(spark):
    template = spark.createDataFrame(
        [(i, f"T{i}", float(i), -1.0) for i in range(5)], "row_id long, id string, c0 double, c1 double"
    )
    outputs = spark.createDataFrame(
        [(0, [0.5, 1.5]), (1, None), (2, [9.0]), (3, [1.0, 2.0, 3.0]), (7, [7.0, 7.0])],
        "row_id long, embedding array<float>",
    )
    got = positional_fallback_join(template, outputs).orderBy("row_id").collect()
    assert [tuple(r) for r in got] == [
        (0, "T0", 0.5, 1.5), (1, "T1", 1.0, -1.0), (2, "T2", 2.0, -1.0), (3, "T3", 3.0, -1.0),
        (4, "T4", 4.0, -1.0),
    ]


def test_last_answer_counts_by_id(spark):
    template = spark.createDataFrame([(0, "T0", 0.0)], "row_id long, id string, c0 double")
    outputs = spark.createDataFrame(
        [(3, "T0", [2.0]), (9, "T0", [5.0]), (1, "T0", [1.0])],
        "row_id long, id string, embedding array<float>",
    )
    got = positional_fallback_join(template, outputs, by="id").collect()
    assert [tuple(r) for r in got] == [(0, "T0", 5.0)]


def test_no_task_compares_more_pairs_than_its_share(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "_shape", lambda df: (100_000, 64))
    r, c = retrieval._grid_of(None, None, None, None)
    assert -(-100_000 // r) * -(-100_000 // c) <= 1 << 31
    monkeypatch.undo()
    # One file is one split, whatever it holds: it is dealt over the cores all the same.
    monkeypatch.setattr(retrieval, "TASK_PAIRS", 1_000)
    vectors = np.random.default_rng(6).normal(size=(300, 4)).astype(np.float32)
    stored = table(spark, vectors, "doc_id").coalesce(1)
    dealt, tasks = retrieval._dealt(stored, 20, 4)
    held = dealt.groupBy(F.spark_partition_id()).count().collect()
    assert len(held) > 1 and max(r["count"] for r in held) < 300 and tasks >= len(held)
    queries = vectors[:20] + np.float32(0.25)
    assert rows(retrieval.knn_join(table(spark, queries, "id"), stored, 4)) == brute(queries, vectors, 4)


def test_kernel_far_from_the_origin():
    """Single precision cannot tell these distances apart; the result is exact all the same."""
    rng = np.random.default_rng(7)
    vectors = 1e6 + rng.normal(size=(700, 6))
    nearest, bounded = Nearest(vectors[:30], 3), Bounded(vectors[:30], 3)
    for start in range(0, 700, 90):
        part = slice(start, start + 90)
        ids = np.arange(700)[part]
        nearest.add(vectors[part], ids)
        bounded.add(vectors[part], np.zeros(len(ids)), ids, ids)
    exact = ((vectors[:30, None] - vectors[None]) ** 2).sum(axis=2)
    want = np.argsort(exact, axis=1, kind="stable")[:, :3]
    assert nearest.ids.reshape(30, 3).tolist() == want.tolist()
    row, ids, *_ = bounded.rows()
    assert all(set(want[q]) <= set(ids[row == q]) for q in range(30))


def test_distances_to_pivots_are_held_in_slices(spark, monkeypatch):
    sizes = []
    original = retrieval._distances
    monkeypatch.setattr(retrieval, "PIVOT_ENTRIES", 40)
    monkeypatch.setattr(retrieval, "_distances", lambda data, centres: sizes.append(len(data) * len(centres)) or original(data, centres))
    for some in retrieval._slices(pd.Series(list(np.ones((25, 3)))), 8):
        retrieval._distances(some, np.zeros((8, 3)))
    assert len(sizes) == 5 and max(sizes) <= 40
    monkeypatch.undo()
    monkeypatch.setattr(retrieval, "PIVOT_ENTRIES", 40)
    vectors = np.random.default_rng(8).normal(size=(200, 4)).astype(np.float32)
    queries = vectors[:15] + np.float32(0.25)
    got = retrieval.knn_join_pruned(table(spark, queries, "id"), table(spark, vectors, "doc_id"), 4, 9)
    assert rows(got) == brute(queries, vectors, 4)


def test_pruned_search_writes_no_vector_for_every_cell_it_visits(spark, monkeypatch):
    """Vectors without clusters: the bounds rule little out, and still every table is as long as the rows or the hits."""
    sizes = {}
    original = retrieval.written

    def counted(df, name, path=None):
        out = original(df, name, path)
        sizes[name] = max(sizes.get(name, 0), out.count())
        return out

    monkeypatch.setattr(retrieval, "written", counted)
    rng = np.random.default_rng(9)
    passages = rng.normal(size=(600, 16)).astype(np.float32)
    passages[::5] = passages[0]
    passages[1::50] *= 4
    queries = np.concatenate([passages[:40], rng.normal(size=(30, 16))]).astype(np.float32)
    asked, stored = table(spark, queries, "id"), table(spark, passages, "doc_id").repartition(5)
    for blocks in ((None, None), (20, 30)):
        assert rows(retrieval.knn_join_pruned(asked, stored, 3, 40, *blocks)) == brute(queries, passages, 3)
    assert max(sizes.values()) <= 600
    assert retrieval.knn_join_pruned(asked.limit(0), stored, 3, 40).count() == 0
