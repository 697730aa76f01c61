"""Exact substring deduplication over a sparse suffix array.

Every string of ``length`` bytes contains, within its first ``LEAD`` bytes, a sampled
position: the least hash of a ``GRAM``-byte string in some window that lies inside. Two
equal strings contain the same ones, so comparing the suffixes at sampled positions, and
the bytes just before them, finds every repeat. Equal strings share at least
``length - LEAD + GRAM`` bytes after such a position; suffixes whose leading bytes occur
once are dropped by counting hashes. Positions whose whole surroundings occur again are
settled by a count as well. Only what is left is sorted: sampled splitters range-partition
the suffixes by their leading bytes, each bucket sorts them, and their reversed left
sides, by multikey sorting on eight-byte words, and neighbouring common prefixes give, for
each offset, which strings are equal. A run of leading bytes with more different
surroundings than a bucket takes lies across bucket boundaries; its strings are compared
over all buckets by counting their hashes, offset by offset.

Defined results: a null text is empty; texts shorter than ``length`` lose nothing; rows
repeated whole are copies of each other. An empty table gives an empty result. Other
columns are not read. One text is held by one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from qaloom.lineage import written, written_side
from qaloom.llm.batches import MULT, blocks, mix

LENGTH = 400
GRAM = 32
PIECE = 1 << 20  # bytes sampled at once
PLACE_BITS = 24  # of a position inside a piece, below the hash
BUCKET_ROWS = 20_000  # suffixes that one pass of a bucket sorts

BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(MULT))


def lead_of(length: int) -> int:
    """Bytes of a string within which its sampled position lies."""
    return length * 3 // 4


def gram_of(length: int) -> int:
    return max(1, min(GRAM, length // 4))


def sampled(raw: np.ndarray, lead: int, gram: int) -> np.ndarray:
    """Positions of the least ``gram``-byte hash of each ``lead``-byte window; the first of equals."""
    count = lead - gram + 1
    found = []
    for start in range(0, max(len(raw) - lead + 1, 0), PIECE - lead + 1):
        piece = raw[start : start + PIECE]
        if len(piece) < lead:
            break
        h, width = BYTE_CODES[piece], 1
        while width < gram:  # a hash of 2w bytes from two of w; the last step may overlap
            step = min(width, gram - width)
            h = h[: len(h) - step] * np.uint64(pow(MULT, 2 * width + 1, 1 << 64)) + h[step:]
            width += step
        h = mix(h) >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS)
        h |= np.arange(len(h), dtype=np.uint64)
        windows = len(h) - count + 1
        padded = np.full(-(-len(h) // count) * count, np.iinfo(np.uint64).max, np.uint64)
        padded[: len(h)] = h
        rows = padded.reshape(-1, count)
        before = np.minimum.accumulate(rows, axis=1).ravel()
        after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(after[:windows], before[count - 1 : count - 1 + windows])
        least = least[np.concatenate([[True], least[1:] != least[:-1]])]
        found.append((least & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64) + start)
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


ANCHOR = "text_hash long, pos int, left int, right int, lead long, around long"


def anchors(docs: DataFrame, length: int) -> DataFrame:
    """Sampled positions with the hash of the bytes each repeat must share and of all bytes that matter."""
    lead, gram = lead_of(length), gram_of(length)
    reach, shared = lead - gram, length - lead + gram
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "text_hash", "pos", "left", "right", "lead", "around"]
        for batch in batches:
            for part, raw, offsets in blocks(batch):
                at = sampled(raw, lead, gram)
                row = np.searchsorted(offsets, at, side="right") - 1
                left = np.minimum(at - offsets[row], reach)
                right = np.minimum(offsets[row + 1] - at, length)
                fit = left + right >= length
                at, row, left, right = at[fit], row[fit], left[fit], right[fit]
                data, digest = memoryview(raw.tobytes()), xxhash.xxh3_64_intdigest
                leads = [digest(data[a : a + shared]) for a in at.tolist()]
                around = [
                    digest(data[a - b : a + c], b << 20 | c) for a, b, c in zip(at.tolist(), left.tolist(), right.tolist())
                ]
                row_ids = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(row_ids),
                        part.column(1).take(row_ids),
                        pa.array((at - offsets[row]).astype(np.int32)),
                        pa.array(left.astype(np.int32)),
                        pa.array(right.astype(np.int32)),
                        pa.array(np.array(leads, np.uint64).view(np.int64)),
                        pa.array(np.array(around, np.uint64).view(np.int64)),
                    ],
                    names,
                )

    return docs.select("doc_id", "text_hash", "text").mapInArrow(run, f"doc_id {kind}, {ANCHOR}")


def multikey_order(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows of big-endian words and, per place in it, the words shared with the row before.

    Rows equal so far form a run; each round sorts only the runs that are still open by
    their next word.
    """
    n, width = words.shape
    order = np.arange(n)
    common = np.zeros(n, np.int64)
    run = np.zeros(n, np.int64)  # number of the run that each place belongs to
    for depth in range(width):
        size = np.bincount(run)
        open_ = np.flatnonzero(size[run] > 1)
        if not len(open_):
            break
        rows = order[open_]
        new = np.lexsort((words[rows, depth], run[open_]))
        order[open_] = rows[new]
        key = words[order[open_], depth]
        same = np.concatenate([[False], (key[1:] == key[:-1]) & (run[open_][1:] == run[open_][:-1])])
        common[open_[same]] = depth + 1
        head = np.ones(n, bool)
        head[open_] = ~same
        run = np.cumsum(head) - 1
    return order, common


def packed(texts: list[bytes], size: int) -> np.ndarray:
    """Rows of zero-padded texts as big-endian 64-bit words, with one word more for the length."""
    width = -(-size // 8) * 8
    rows = np.frombuffer(b"".join(t.ljust(width, b"\0") for t in texts), np.uint8).reshape(len(texts), width)
    return rows


def sorted_common(rows: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order of zero-padded rows and the bytes each shares with its predecessor in it."""
    words = rows.view(">u8").astype(np.uint64)
    order, shared_words = multikey_order(words)
    common = np.zeros(len(rows), np.int64)
    a, b = rows[order[1:]], rows[order[:-1]]
    differ = a != b
    first = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    common[1:] = np.minimum(first, np.minimum(sizes[order[1:]], sizes[order[:-1]]))
    return order, common


def repeated_offsets(lefts: list[bytes], rights: list[bytes], length: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest offset at which each row's string occurs in another row; -1 where none does.

    The string at offset o is the last o bytes of the left side and the first length - o
    of the right one. Rows equal in both stand in one block of the suffix order cut where
    fewer than length - o bytes are common, and in one block of the order of reversed left
    sides cut below o.
    """
    n = len(lefts)
    l_size = np.array([len(x) for x in lefts])
    r_size = np.array([len(x) for x in rights])
    r_order, r_common = sorted_common(packed(rights, length), r_size)
    l_order, l_common = sorted_common(packed([x[::-1] for x in lefts], max(reach, 1)), l_size)
    low, high = np.full(n, -1), np.full(n, -1)
    r_block, l_block = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for o in range(reach + 1):
        cut = r_common < length - o
        valid = (l_size >= o) & (r_size >= length - o)
        alive = cut.copy()
        alive[:-1] &= cut[1:]  # alone in its block
        alone = np.zeros(n, bool)
        alone[r_order] = alive
        some = np.flatnonzero(valid & ~alone)
        if len(some) < 2:
            continue
        r_block[r_order] = np.cumsum(cut)
        l_block[l_order] = np.cumsum(l_common < o)
        code = r_block[some] * np.int64(n + 1) + l_block[some]
        order = np.argsort(code, kind="stable")
        same = code[order][1:] == code[order][:-1]
        twice = np.zeros(len(some), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        hit = some[twice]
        low[hit[low[hit] < 0]] = o
        high[hit] = o
    return low, high


def bucket_spans(contexts: DataFrame, length: int, rows_at_once: int) -> DataFrame:
    """Spans found inside range-partitioned buckets of sorted suffixes."""
    reach = lead_of(length) - gram_of(length)
    kind = contexts.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0

        def solve(batch: pa.Table) -> pa.RecordBatch:
            low, high = repeated_offsets(batch["before"].to_pylist(), batch["after"].to_pylist(), length, reach)
            hit = np.flatnonzero((low >= 0) & batch["single"].to_numpy())
            pos = batch["pos"].to_numpy()[hit]
            take = batch.take(pa.array(hit)).combine_chunks()
            column = lambda name: take[name].combine_chunks() if take.num_rows else pa.array([], take.schema.field(name).type)
            return pa.RecordBatch.from_arrays(
                [
                    column("doc_id"),
                    column("text_hash"),
                    pa.array((pos - high[hit]).astype(np.int32)),
                    pa.array((pos - low[hit] + length).astype(np.int32)),
                ],
                ["doc_id", "text_hash", "start", "end"],
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows < rows_at_once:
                continue
            whole = pa.Table.from_batches(held)
            leads = whole["lead"].to_numpy()
            stop = int(np.flatnonzero(leads != leads[-1])[-1]) + 1 if (leads != leads[-1]).any() else 0
            if stop:  # the last lead may go on in the next batch
                yield solve(whole.slice(0, stop))
                held = whole.slice(stop).to_batches()
                rows = whole.num_rows - stop
        if rows:
            yield solve(pa.Table.from_batches(held))

    return (
        contexts.repartitionByRange("prefix", "lead")
        .sortWithinPartitions("prefix", "lead")
        .select("doc_id", "text_hash", "pos", "single", "lead", "before", "after")
        .mapInArrow(run, f"doc_id {kind}, text_hash long, start int, end int")
    )


def counted_spans(contexts: DataFrame, length: int) -> DataFrame:
    """The same for leading bytes with too many surroundings for a bucket: strings counted by hash."""
    reach = lead_of(length) - gram_of(length)
    whole = F.concat("before", "after")
    begin = F.length("before") - F.col("o")
    windows = (
        contexts.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(reach))))
        .where((F.length("before") >= F.col("o")) & (F.length("after") >= length - F.col("o")))
        .withColumn("string", F.substring(whole, begin + 1, F.lit(length)))
        .select("doc_id", "text_hash", "pos", "single", "lead", "o", F.xxhash64("string").alias("h"), F.crc32("string").alias("c"))
    )
    windows = written(windows, "substring-windows")
    keys = ["lead", "o", "h", "c"]
    twice = written(windows.groupBy(*keys).count().where("count > 1").select(*keys), "substring-twice")
    return (
        windows.where("single")
        .join(twice, keys, "left_semi")
        .groupBy("doc_id", "text_hash", "pos")
        .agg(F.min("o").alias("low"), F.max("o").alias("high"))
        .select("doc_id", "text_hash", (F.col("pos") - F.col("high")).alias("start"), (F.col("pos") - F.col("low") + length).alias("end"))
    )


def repeated_spans(docs: DataFrame, length: int = LENGTH, rows_at_once: int = BUCKET_ROWS) -> DataFrame:
    """``doc_id``, ``text_hash``, ``start``, ``end``: byte spans covered by repeated strings; they may overlap.

    ``docs`` has ``doc_id``, ``text_hash`` (a long that tells texts of one id apart), ``text``.
    """
    if length < 16:
        raise ValueError("strings shorter than 16 bytes repeat everywhere")
    reach = lead_of(length) - gram_of(length)
    shared = length - reach
    everywhere = written(anchors(docs, length), "substring-anchors")
    leads = written(
        everywhere.groupBy("lead")
        .agg(F.count("*").alias("n"), F.min("around").alias("a"), F.max("around").alias("b"))
        .where("n > 1")
        .select("lead", (F.col("a") != F.col("b")).alias("several")),
        "substring-leads",
    )
    repeats = written(everywhere.join(leads, "lead"), "substring-repeats")
    whole = ["doc_id", "text_hash", (F.col("pos") - F.col("left")).alias("start"), (F.col("pos") + F.col("right")).alias("end")]
    same = repeats.where("not several").select(*whole)
    several = repeats.where("several")
    place = F.struct("doc_id", "text_hash", "pos", "left", "right")
    classes = written(several.groupBy("lead", "around").agg(F.count("*").alias("n"), F.min(place).alias("p")), "substring-classes")
    copies = several.join(classes.where("n > 1").select("lead", "around"), ["lead", "around"], "left_semi").select(*whole)
    hot = written_side(
        classes.groupBy("lead").count().where(F.col("count") > rows_at_once).select("lead", F.lit(True).alias("hot")), "substring-hot"
    )
    wanted = (
        classes.join(hot, "lead", "left")
        .groupBy("p.doc_id", "p.text_hash")
        .agg(F.collect_list(F.struct("p.pos", "p.left", "p.right", "lead", (F.col("n") == 1).alias("single"), F.coalesce("hot", F.lit(False)).alias("hot"))).alias("places"))
    )
    wanted = written(wanted.withColumnRenamed("doc_id", "id").withColumnRenamed("text_hash", "th"), "substring-wanted")
    text = F.col("text").cast("binary")
    contexts = (
        docs.join(wanted, docs.doc_id.eqNullSafe(wanted.id) & (docs.text_hash == wanted.th))
        .select("doc_id", "text_hash", "text", F.explode("places").alias("x"))
        .select(
            "doc_id",
            "text_hash",
            "x.pos",
            "x.single",
            "x.lead",
            "x.hot",
            F.substring(text, F.col("x.pos") + 1, F.lit(8)).alias("prefix"),
            F.substring(text, F.col("x.pos") - F.col("x.left") + 1, F.col("x.left")).alias("before"),
            F.substring(text, F.col("x.pos") + 1, F.col("x.right")).alias("after"),
        )
    )
    contexts = written(contexts, "substring-contexts")
    spans = same.union(copies).union(bucket_spans(contexts.where("not hot"), length, rows_at_once))
    return spans.union(counted_spans(contexts.where("hot"), length)) if hot.limit(1).count() else spans


def without_repeats(docs: DataFrame, length: int = LENGTH, rows_at_once: int = BUCKET_ROWS) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``spans`` (merged, of bytes), ``kept``: each text without its repeated bytes."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    spans = repeated_spans(docs, length, rows_at_once)
    per_text = (
        spans.groupBy(F.col("doc_id").alias("id"), F.col("text_hash").alias("th"))
        .agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans"))
    )
    per_text = written(per_text, "substring-spans")
    joined = docs.join(per_text, docs.doc_id.eqNullSafe(per_text.id) & (docs.text_hash == per_text.th), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, merged, kept = [], [], []
            for value, found in zip(batch.column(1), batch.column(2).to_pylist()):
                data = value.as_buffer().to_pybytes()
                runs: list[tuple[int, int]] = []
                for span in found or ():
                    if runs and span["start"] <= runs[-1][1]:
                        runs[-1] = (runs[-1][0], max(runs[-1][1], span["end"]))
                    else:
                        runs.append((span["start"], span["end"]))
                sizes.append(len(data))
                merged.append([{"start": a, "end": b} for a, b in runs])
                edges = [0, *(x for run_ in runs for x in run_), len(data)]
                kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2])))
            kind_ = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(merged, kind_), pa.array(kept, pa.binary())],
                ["doc_id", "n_bytes", "spans", "kept"],
            )

    return joined.select("doc_id", "text", "spans").mapInArrow(
        run, f"doc_id {kind}, n_bytes long, spans array<struct<start:int,end:int>>, kept binary"
    )


def digest(result: DataFrame) -> DataFrame:
    """Counts and hash of what ``without_repeats`` left, and whether it removed anything."""
    return result.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
        (F.size("spans") > 0).alias("has_repeats"),
    )
