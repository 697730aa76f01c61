"""Benchmark decontamination by greedy string tiling.

Documents and test items are word sequences (letters and digits, lower case). A seed is as
many words in a row as the shortest tile. Tiles that cover ``COVERAGE`` of an item hold at
least ``needed`` of its seeds, so a document without so many is out; of the others the
neighbourhoods of longer runs (``SEED`` words) and the stretches with so many seeds within
``NEAR`` times the item's length are tiled with the item: again and again the longest common run of words that no tile covers yet becomes a
tile, found by hashing all runs of the current length and halving it (running Karp-Rabin).
An item leaked if the tiles cover at least ``COVERAGE`` of its words; their order does not
matter, so reordered passages are caught. Short tiles that lie farther apart than ``NEAR``
times the item's length are chance, not a passage.

The seeds of the items go to every executor. Their number is counted first: beyond
``BLOCK_SEEDS`` the items are cut into blocks and the documents pass one block after the
other, written in between, so no task holds more than one block. Documents never move.

Defined results: null texts and texts without words match nothing; an item with fewer
words than a seed is its own seed; items repeated under one id count once each. Empty
tables give no matches. Columns keep their names; a clash with the new column is an error.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from qaloom.lineage import written
from qaloom.llm.batches import LETTER, blocks, grams, lowered, span_hashes, words
from qaloom.llm.registry import free_name

SEED = 5  # words of a run that is worth tiling around by itself
TILE = 3
NEAR = 2
COVERAGE = 0.8
BLOCK_SEEDS = 1_000_000

LEAKS = "array<struct<item_id:long,coverage:double,start:int,end:int>>"


def tiles(pattern: list[int], text: list[int], least: int) -> list[tuple[int, int, int]]:
    """(length, place in pattern, place in text) of greedy tiles of at least ``least`` words.

    Longest first; among equals the first in the pattern, then the first in the text.
    """
    free_p, free_t = [True] * len(pattern), [True] * len(text)
    found: list[tuple[int, int, int]] = []
    size = max(least, min(len(pattern), len(text)))
    while size >= least:
        runs = maximal_runs(pattern, text, free_p, free_t, size)
        heapq.heapify(runs)
        while runs:
            negative, p, t = heapq.heappop(runs)
            length = -negative
            open_ = [free_p[p + j] and free_t[t + j] for j in range(length)]
            if all(open_):
                found.append((length, p, t))
                for j in range(length):
                    free_p[p + j] = free_t[t + j] = False
                continue
            start = 0  # what a longer tile left of this run stays in the race
            for j in range(length + 1):
                if j == length or not open_[j]:
                    if j - start >= size:
                        heapq.heappush(runs, (start - j, p + start, t + start))
                    start = j + 1
        size = max(size // 2, least) if size > least else 0
    return found


def maximal_runs(pattern: list[int], text: list[int], free_p: list[bool], free_t: list[bool], size: int) -> list[tuple[int, int, int]]:
    """All maximal common runs of at least ``size`` free words, as (-length, p, t)."""
    index: dict[int, list[int]] = {}
    for p, key in rolling(pattern, free_p, size):
        index.setdefault(key, []).append(p)
    out = []
    for t, key in rolling(text, free_t, size):
        for p in index.get(key, ()):
            if p and t and free_p[p - 1] and free_t[t - 1] and pattern[p - 1] == text[t - 1]:
                continue  # inside a run that began earlier
            length = 0
            while (
                p + length < len(pattern)
                and t + length < len(text)
                and free_p[p + length]
                and free_t[t + length]
                and pattern[p + length] == text[t + length]
            ):
                length += 1
            if length >= size:
                out.append((-length, p, t))
    return out


PRIME = (1 << 61) - 1
BASE = 0x1F35A7BD3C91


def rolling(values: list[int], free: list[bool], size: int) -> Iterator[tuple[int, int]]:
    """Karp-Rabin hash of every run of ``size`` free values."""
    drop = pow(BASE, size, PRIME)
    key, run = 0, 0
    for i, value in enumerate(values):
        if not free[i]:
            key, run = 0, 0
            continue
        key = (key * BASE + value) % PRIME
        run += 1
        if run > size:
            key = (key - values[i - size] * drop) % PRIME
        if run >= size:
            yield i - size + 1, key


def needed(length: int, coverage: float, size: int) -> int:
    """Seeds of ``size`` words, by place in the item, that tiles covering enough of it hold at least."""
    return max(1, int(np.ceil(coverage * length / size - 1e-9)))


MAYBE = np.uint64((1 << 22) - 1)


class Items:
    """One block of test items with the seeds that lead to them.

    Items shorter than a seed are their own seed; one table for each length of seeds.
    """

    def __init__(self, rows: list[tuple[int, list[int]]], coverage: float = COVERAGE, least: int = TILE):
        self.rows = rows
        self.need = np.array([needed(len(own), coverage, min(least, len(own) or 1)) for _, own in rows], np.int64)
        self.long = {i: np.unique(grams(np.array(own, np.uint64), SEED)) for i, (_, own) in enumerate(rows) if len(own) >= SEED}
        self.seeds: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        seeds: dict[int, list[tuple[np.ndarray, np.ndarray, int]]] = {}
        for i, (_, own) in enumerate(rows):
            if own:
                size = min(least, len(own))
                self.seeds[i] = np.unique(grams(np.array(own, np.uint64), size), return_counts=True)
                seeds.setdefault(size, []).append((*self.seeds[i], i))
        self.tables = {}
        for size, parts in seeds.items():
            keys = np.concatenate([k for k, _, _ in parts])
            times = np.concatenate([n for _, n, _ in parts])
            owner = np.concatenate([np.full(len(k), i) for k, _, i in parts])
            order = np.argsort(keys, kind="stable")
            keys, firsts = np.unique(keys[order], return_index=True)
            maybe = np.zeros(1 << 22, bool)
            maybe[(keys & MAYBE).astype(np.int64)] = True
            self.tables[size] = keys, np.append(firsts, len(order)), owner[order], times[order], maybe

    def hits(self, hashes: np.ndarray, text_of: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(text, item, word places of the item's seeds, how often the item has each) where the text has enough seeds."""
        for size, (keys, firsts, owner, times, maybe) in self.tables.items():
            own = grams(hashes, size)
            if not len(own):
                continue
            some = np.flatnonzero(maybe[(own & MAYBE).astype(np.int64)])
            some = some[text_of[some] == text_of[some + size - 1]]
            seed = np.minimum(np.searchsorted(keys, own[some]), len(keys) - 1)
            known = keys[seed] == own[some]
            places, seed = some[known], seed[known]
            if not len(places):
                continue
            # Each seed counts once for a text, however often the text has it.
            pairs = np.unique(text_of[places] * len(keys) + seed)
            n = np.diff(firsts)[pairs % len(keys)]
            at = np.repeat(firsts[pairs % len(keys)] - np.cumsum(n) + n, n) + np.arange(n.sum())
            both, where = np.unique(np.repeat(pairs // len(keys), n) * len(self.rows) + owner[at], return_inverse=True)
            total = np.bincount(where, weights=times[at])
            both = both[total >= self.need[both % len(self.rows)]]
            bounds = np.searchsorted(text_of[places], [both // len(self.rows), both // len(self.rows) + 1])
            for text, item, a, b in zip(both // len(self.rows), both % len(self.rows), *bounds):
                mine, count = self.seeds[item]
                k = np.minimum(np.searchsorted(mine, keys[seed[a:b]]), len(mine) - 1)
                of_item = mine[k] == keys[seed[a:b]]
                yield int(text), int(item), places[a:b][of_item], count[k][of_item]

    def dense(self, item: int, places: np.ndarray, times: np.ndarray, hashes: np.ndarray, end: int) -> np.ndarray:
        """The places in a long run of the item, or in a stretch of ``NEAR`` times its length with enough seeds."""
        length = len(self.rows[item][1])
        total = np.concatenate([[0], np.cumsum(times)])
        stop = np.searchsorted(places, places + NEAR * length)
        full = np.flatnonzero(total[stop] - total[:-1] >= self.need[item])
        inside = np.zeros(len(places) + 1, np.int64)
        np.add.at(inside, full, 1)
        np.add.at(inside, stop[full], -1)
        kept = np.cumsum(inside[:-1]) > 0
        if item in self.long:
            runs = np.flatnonzero(places + SEED <= end)
            if len(runs):
                own = grams(hashes[places[0] : end], SEED)[places[runs] - places[0]]
                kept[runs] |= np.isin(own, self.long[item])
        return places[kept]


def leaks_of(raw: np.ndarray, offsets: np.ndarray, items: Items, coverage: float, least: int) -> list[list[dict]]:
    n = len(offsets) - 1
    small = lowered(raw)
    starts, ends, first = words(small, offsets, LETTER)
    hashes = span_hashes(small, starts, ends)
    text_of = np.repeat(np.arange(n), np.diff(first))
    out: list[list[dict]] = [[] for _ in range(n)]
    for i, k, places, times in sorted(items.hits(hashes, text_of), key=lambda hit: hit[:2]):
        item_id, pattern = items.rows[k]
        reach = len(pattern) + SEED
        near: list[int] = []  # word places around the seeds; -1 parts those that are not neighbours
        for place in items.dense(k, places, times, hashes, int(first[i + 1])).tolist():
            a = max(place - reach, int(first[i]), near[-1] + 1 if near else 0)
            if near and a > near[-1] + 1:
                near.append(-1)
            near.extend(range(a, min(place + reach, int(first[i + 1]))))
        if not near:
            continue
        text = [-1 if place < 0 else int(hashes[place]) for place in near]
        found = tiles(pattern, text, min(least, len(pattern)))
        covered = sum(length for length, _, _ in found) / len(pattern)
        if covered >= coverage:
            begin = min(near[t] for _, _, t in found)
            end = max(near[t + length - 1] for length, _, t in found)
            out[i].append(
                {"item_id": item_id, "coverage": covered, "start": int(starts[begin] - offsets[i]), "end": int(ends[end] - offsets[i])}
            )
    return out


def item_words(items: DataFrame) -> DataFrame:
    """``item_id``, ``words``: hashes of the words of every item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, offsets in blocks(batch):
                small = lowered(raw)
                starts, ends, first = words(small, offsets, LETTER)
                lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(span_hashes(small, starts, ends).view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], ["item_id", "words"])

    return items.select(F.col("item_id").cast("long"), "text").mapInArrow(run, "item_id long, words array<long>")


def annotate(
    docs: DataFrame,
    items: DataFrame,
    out: str = "leaks",
    coverage: float = COVERAGE,
    least: int = TILE,
    block_seeds: int = BLOCK_SEEDS,
) -> DataFrame:
    """``docs`` with ``out``: the items each text leaks, their coverage and the byte span of the tiles."""
    if any(c.lower() == out.lower() for c in docs.columns):
        raise ValueError(f"column {out} exists; name another with out=")
    spark = docs.sparkSession
    known = written(item_words(items), "tiling-items")
    seeds = known.agg(F.sum(F.size("words"))).first()[0] or 0
    count = max(1, -(-int(seeds) // block_seeds))
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("coverage", pa.float64()), ("start", pa.int32()), ("end", pa.int32())]))
    schema = StructType([*docs.schema.fields, StructField(out, _parse_datatype_string(LEAKS))])
    result = docs.withColumn(out, F.array().cast(LEAKS))
    for k in range(count):
        block = known.where(F.pmod(F.xxhash64("item_id", "words"), F.lit(count)) == k).collect()  # some BLOCK_SEEDS words
        rows = sorted((r.item_id if r.item_id is not None else -1, r.item_id, [w % (1 << 64) for w in r.words]) for r in block)
        shared = spark.sparkContext.broadcast([(i, own) for _, i, own in rows])

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = Items(shared.value, coverage, least)
            for batch in batches:
                for part, raw, offsets in blocks(batch):
                    before = part.column(out).to_pylist()
                    found = leaks_of(raw, offsets, own, coverage, least)
                    lists = pa.array([a + b for a, b in zip(before, found)], kind)
                    columns = [lists if name == out else column for name, column in zip(part.schema.names, part.columns)]
                    yield pa.RecordBatch.from_arrays(columns, part.schema.names)

        result = result.mapInArrow(run, schema)
        if k + 1 < count:
            result = written(result, "tiling-block")
    return result


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Per document: whether it leaks, the greatest coverage and the leaked items."""
    leaks = F.sort_array("leaks")
    return annotate(docs.select("doc_id", "text"), items).select(
        "doc_id",
        (F.size("leaks") > 0).alias("contaminated"),
        F.coalesce(F.array_max(F.transform("leaks", lambda x: x["coverage"])), F.lit(0.0)).alias("coverage"),
        F.transform(leaks, lambda x: x["item_id"]).alias("item_ids"),
        leaks.alias("leaks"),
    )


def keep_clean(docs: DataFrame, items: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """The documents that leak no item, with the columns they came with."""
    out = free_name(docs, "leaks")
    marked = annotate(docs, items, out, coverage)
    return marked.where(F.size(out) == 0).select(*[marked[c] for c in docs.columns])
