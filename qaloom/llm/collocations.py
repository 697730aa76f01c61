"""Collocations mined with sorted occurrence relations, one written per phrase length.

The relation of length k holds, for each text, the sorted positions where a frequent phrase
of k words starts and that phrase's number; a break between pieces leaves a gap in the
positions. Merge-joining a relation with itself one position on gives the phrases of k + 1
words: both of their parts of k words must be frequent, so none is missed. They are counted
in groups, the frequent groups numbered, and a semi-join with those leaves the next
relation. Each relation is written sorted and read once to count and once to extend.

Frequent groups are broadcast where they were counted to be few, which keeps the order of
the occurrences; else both sides are shuffled and the occurrences sorted again. Counts are
summed inside each batch and task before they move, so a word or pair that makes up a third
of the data is one row per task.

A candidate's score compares its count with what its two parts would give by chance, at the
cut that explains it best; see ``mined``. A candidate inside a longer one that is as
frequent goes. It is enough to look at candidates one word longer: those in between are at
least as frequent as the longest.

Defined results: a null text is empty; a null language is ``und``, as is that string;
repeated rows count each; ties in score and count go by the phrase's bytes. An empty table
gives no rows. Only the language and the text are read. One text's positions are held by
one task, whatever its length.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from qaloom import lineage
from qaloom.lineage import written
from qaloom.llm.batches import blocks, words

LEAST = 100  # occurrences of a candidate
LONGEST = 5  # words of a candidate
TOP = 2000  # rows per language
COVER = 100  # percent of a candidate's count at which a longer one replaces it

# What ends a piece, and what ends a word inside one.
PIECE_END = np.zeros(256, bool)
PIECE_END[[ord(c) for c in ".,;:!?"]] = True
PIECE_END[0x0A:0x0E] = True
WORD = ~PIECE_END
WORD[[0x20, 0x09]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_ROWS, _BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def wide_batches(spark: SparkSession, rows: int = 1 << 15, size: int = 4 << 20):
    """Arrow batches bounded by bytes, for relations of narrow rows."""
    before = {c: spark.conf.get(c) for c in (_ROWS, _BYTES)}
    spark.conf.set(_ROWS, str(rows))
    spark.conf.set(_BYTES, str(size))
    try:
        yield
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)


def occurrences(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Position and word of every occurrence, and the n + 1 occurrence offsets of the texts.

    Neighbours in a piece are one apart, and no other two occurrences of a text are.
    """
    raw = LOWER[raw]
    starts, ends, first = words(raw, offsets, WORD)
    if not len(starts):
        return np.zeros(0, np.int32), pa.array([], pa.string()), first
    breaks = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(PIECE_END[raw], out=breaks[1:])
    moved = np.zeros(len(starts), np.int64)
    moved[1:] = breaks[starts[1:]] > breaks[ends[:-1]]
    at = np.arange(len(starts)) + np.cumsum(moved)
    own = np.flatnonzero(np.diff(first))
    at -= np.repeat(at[first[own]], np.diff(first)[own])
    ends_of = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    letters = raw[WORD[raw]].tobytes()
    found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends_of.tobytes()), pa.py_buffer(letters)])
    return at.astype(np.int32), found.cast(pa.large_string()), first


def word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``lang, word, n`` of each block, and a row without a word for all words of the language."""
    for batch in batches:
        for part, raw, offsets in blocks(batch, "text"):
            _, found, first = occurrences(raw, offsets)
            langs, coded = part.column("lang").dictionary_encode(), found.dictionary_encode()
            if not len(found):
                continue
            lang = np.repeat(langs.indices.to_numpy(), np.diff(first)).astype(np.int64)
            size = len(coded.dictionary)
            keys, n = np.unique(lang * size + coded.indices.to_numpy(), return_counts=True)
            totals = np.bincount(lang, minlength=len(langs.dictionary))
            columns = [
                pa.concat_arrays([langs.dictionary.take(pa.array(keys // size)), langs.dictionary]),
                pa.concat_arrays([coded.dictionary.take(pa.array(keys % size)).cast(pa.string()), pa.nulls(len(totals), pa.string())]),
                pa.array(np.concatenate([n, totals])),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "word", "n"])


def word_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``part, lang``, and the sorted positions and words of every text."""
    for batch in batches:
        for part, raw, offsets in blocks(batch, "text"):
            at, found, first = occurrences(raw, offsets)
            lists = [pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), x) for x in (pa.array(at), found.cast(pa.string()))]
            yield pa.RecordBatch.from_arrays([*part.columns[:2], *lists], ["part", "lang", "at", "word"])


def regrouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences sorted by part and position, as one row per part."""

    def rows(part: np.ndarray, at: np.ndarray, gid: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        offsets = pa.array(np.append(starts, len(part)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (at, gid)]
        return pa.RecordBatch.from_arrays([pa.array(part[starts]), *lists], ["part", "at", "gid"])

    pieces: list[list[np.ndarray]] = [[], [], []]
    for batch in batches:
        if not batch.num_rows:
            continue
        new = [c.to_numpy() for c in batch.columns]
        for p, x in zip(pieces, new):
            p.append(x)
        last = new[0][-1]
        if pieces[0][0][0] == last:
            # All of it is one text, which may go on: nothing is copied until it ends.
            continue
        part, at, gid = (np.concatenate(p) for p in pieces)
        cut = len(part) - int(np.argmax(part[::-1] != last))
        yield rows(part[:cut], at[:cut], gid[:cut])
        pieces = [[part[cut:]], [at[cut:]], [gid[cut:]]]
    if pieces[0]:
        yield rows(*(np.concatenate(p) for p in pieces))


def neighbours(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The merge-join of a relation with itself one position on: part, position, left and right group."""
    lists = batch.column("at")
    offsets = lists.offsets.to_numpy()
    at, gid = (batch.column(c).flatten().to_numpy() for c in ("at", "gid"))
    if len(at) < 2:
        none = np.zeros(0, np.int64)
        return none, np.zeros(0, np.int32), none, none
    part = np.repeat(batch.column("part").to_numpy(), np.diff(offsets))
    i = np.flatnonzero((at[1:] == at[:-1] + 1) & (part[1:] == part[:-1]))
    return part[i], at[i], gid[i], gid[i + 1]


def pair_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        _, _, left, right = neighbours(batch)
        counted = pa.table({"left": left, "right": right}).group_by(["left", "right"], use_threads=False).aggregate([([], "count_all")])
        for out in counted.select(["left", "right", "count_all"]).rename_columns(["left", "right", "n"]).to_batches():
            yield out


def pair_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in neighbours(batch)], ["part", "at", "left", "right"])


def numbered(groups: DataFrame, name: str) -> tuple[DataFrame, int]:
    """Frequent groups, written with a number each, and how many there are."""
    table = written(groups.withColumn("gid", F.monotonically_increasing_id()), name)
    return table, table.count()


def next_relation(rows: DataFrame, groups: DataFrame, count: int, on: list[str], name: str) -> DataFrame:
    """Occurrences of the frequent groups, as a sorted relation; ``rows`` come sorted by part and position."""
    groups = groups.select(*on, "gid")
    if count <= lineage.BROADCAST_ROWS:
        kept = rows.join(F.broadcast(groups), on).select("part", "at", "gid")
    else:
        kept = rows.join(groups, on).select("part", "at", "gid").repartition("part").sortWithinPartitions("part", "at")
    return written(kept.mapInArrow(regrouped, "part long, at array<int>, gid array<long>"), name)


def frequent_phrases(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, list[DataFrame]]:
    """Word total of each language, and for each length the frequent phrases.

    ``lang, n`` and ``gid, lang, words, a, left, right``, where the last two number the
    phrase without its last and without its first word.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.monotonically_increasing_id().alias("part"),
        F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    with wide_batches(spark):
        counted = rows.drop("part").mapInArrow(word_counts, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("a"))
        counted = written(counted.where((F.col("a") >= least) | F.col("word").isNull()), "collocation-words")
        totals = counted.where("word is null").select("lang", F.col("a").alias("n"))
        single, count = numbered(counted.where(F.col("word").isNotNull() & (F.col("a") >= least)), "collocation-groups")
        phrases = [single.select("gid", "lang", F.array("word").alias("words"), "a", F.lit(None).cast("long").alias("left"), F.lit(None).cast("long").alias("right"))]
        lists = rows.mapInArrow(word_lists, "part long, lang string, at array<int>, word array<string>")
        flat = lists.select("part", "lang", F.inline(F.arrays_zip("at", "word")))
        relation = next_relation(flat, single, count, ["lang", "word"], "collocation-relation")
        for length in range(2, longest + 1):
            counted = relation.mapInArrow(pair_counts, "left long, right long, n long").groupBy("left", "right").agg(F.sum("n").alias("a"))
            groups, count = numbered(counted.where(F.col("a") >= least), "collocation-groups")
            if not count:
                break
            before = phrases[-1]
            left = before.select(F.col("gid").alias("left"), "lang", "words")
            right = before.select(F.col("gid").alias("right"), F.element_at("words", -1).alias("last"))
            longer = groups.join(left, "left").join(right, "right")
            longer = longer.select("gid", "lang", F.concat("words", F.array("last")).alias("words"), "a", "left", "right")
            phrases.append(written(longer, "collocation-phrases"))
            if length < longest:
                pairs = relation.mapInArrow(pair_rows, "part long, at int, left long, right long")
                relation = next_relation(pairs, groups, count, ["left", "right"], "collocation-relation")
    return totals, phrases


def mined(
    docs: DataFrame,
    lang: str = "lang",
    text: str = "text",
    least: int = LEAST,
    longest: int = LONGEST,
    top: int | None = TOP,
    cover: int = COVER,
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of each language's collocations, best first.

    Cutting a phrase in two gives floor(1000 a n / (l r)), where a, l and r count the phrase
    and its parts and n all words of the language; the least of these is its score.
    """
    totals, phrases = frequent_phrases(docs, lang, text, least, longest)
    spark = docs.sparkSession
    kept = []
    for k, own in enumerate(phrases[1:], 1):
        if k + 1 < len(phrases):
            longer = phrases[k + 1]
            inside = longer.select(F.col("left").alias("gid"), F.col("a").alias("over")).unionByName(longer.select(F.col("right").alias("gid"), F.col("a").alias("over")))
            own = own.join(inside.groupBy("gid").agg(F.max("over").alias("over")), "gid", "left")
            own = own.where(F.col("over").isNull() | (100 * F.col("over") < cover * F.col("a")))
        kept.append(own.select("lang", "words", "a"))
    if not kept:
        return spark.createDataFrame([], "lang string, rank long, phrase string, a long, l long, r long, n long, score long")
    candidates, counts = kept[0], phrases[0].select("lang", "words", "a")
    for more in kept[1:]:
        candidates = candidates.unionByName(more)
    for more in phrases[1:-1]:
        counts = counts.unionByName(more.select("lang", "words", "a"))
    joined = lambda c: F.array_join(c, " ")
    counts = counts.select("lang", joined("words").alias("phrase"), F.col("a").alias("c"))
    cuts = (
        candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("words") - 1)))
        .select("lang", joined("words").alias("phrase"), "a", "k", joined(F.expr("slice(words, 1, k)")).alias("first"), joined(F.expr("slice(words, k + 1, size(words) - k)")).alias("rest"))
        .join(counts.select("lang", F.col("phrase").alias("first"), F.col("c").alias("l")), ["lang", "first"])
        .join(counts.select("lang", F.col("phrase").alias("rest"), F.col("c").alias("r")), ["lang", "rest"])
        .join(totals, "lang")
        # Products of three counts pass 64 bits; 38 digits hold them exactly.
        .withColumn("score", F.expr("(cast(a as decimal(19, 0)) * cast(n as decimal(19, 0)) * 1000) div (cast(l as decimal(19, 0)) * cast(r as decimal(19, 0)))"))
    )
    best = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("best")).select("lang", "phrase", "best.*")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = best.withColumn("rank", F.row_number().over(order))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score")
