"""SimHash fingerprints and near-duplicate groups found with BK-trees.

A fingerprint has a bit for each bit position of the hashes of a text's word shingles. Two
fingerprints within the radius agree in one of four 16-bit bands, and, in what is left, in
one of four 12-bit sub-bands; so every linked pair meets in a shard keyed by such a band
and sub-band. Each shard builds a BK-tree, whose children hang by their integer Hamming
distance to the parent, and a query follows only the edges within the radius. The trees
grow with the corpus and therefore are dealt out by shard key instead of being broadcast.
Copies share a fingerprint and enter the shards once. A shard hands on a spanning forest
of its links, not its pairs; star contraction joins the forests.

Defined results: a null or wordless text has fingerprint 0 and is linked like any other;
fewer words than a shingle are one shingle. A null id never names a component unless all
ids of the component are null. An empty table gives an empty result; only the key and the
text are read.
One text is held by one task, whatever its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from qaloom.lineage import written, written_side
from qaloom.llm.batches import SPACE, blocks, words
from qaloom.llm.components import components

BITS = 64
RADIUS = 3
SHINGLE = 3
SEED = 42

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def shingle_hashes(raw: np.ndarray, offsets: np.ndarray, size: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every space-joined shingle of lower-cased words, and the n + 1 offsets of the texts."""
    raw = LOWER[raw]
    starts, ends, first = words(raw, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    keep = ~SPACE[raw]
    follow = ends[ends < len(raw)]
    keep[follow] = True
    place = np.cumsum(keep) - 1
    joined = raw[keep]
    joined[SPACE[joined]] = 0x20
    starts, ends = place[starts], place[ends - 1] + 1
    counts = np.diff(first)
    shingles = np.where(counts > 0, np.maximum(counts - size + 1, 1), 0)
    out = np.concatenate([[0], np.cumsum(shingles)])
    text_of = np.repeat(np.arange(len(counts)), shingles)
    head = first[text_of] + np.arange(out[-1]) - out[text_of]
    tail = np.minimum(head + size, first[text_of + 1]) - 1
    data, digest = joined.tobytes(), xxhash.xxh64_intdigest
    hashes = [digest(data[a:b], seed) for a, b in zip(starts[head].tolist(), ends[tail].tolist())]
    return np.array(hashes, np.uint64), out


def majority_bits(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One value per group of hashes: the bits set in more than half of the group."""
    counts = np.diff(offsets)
    out = np.zeros(len(counts), np.uint64)
    some = np.flatnonzero(counts)
    # Many hashes at once would need 64 bytes each; whole groups go together up to a bound.
    start = 0
    while start < len(some):
        stop = max(start + 1, int(np.searchsorted(offsets[some + 1], offsets[some[start]] + (1 << 17), side="right")))
        own = some[start:stop]
        lo, hi = offsets[own[0]], offsets[own[-1] + 1]
        bits = np.unpackbits(hashes[lo:hi].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        sums = np.add.reduceat(bits, offsets[own] - lo, axis=0, dtype=np.int32)
        packed = np.packbits(2 * sums > counts[own][:, None], axis=1, bitorder="little")
        out[own] = np.ascontiguousarray(packed).view("<u8").ravel()
        start = stop
    return out


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """``key`` and ``fp``, the fingerprint's 64 bits as a long."""
    kind = docs.select(key).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, offsets in blocks(batch, text):
                fps = majority_bits(*shingle_hashes(raw, offsets, size, seed))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps.view(np.int64))], [key, "fp"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, fp long")


class BKTree:
    """Fingerprints under a root; the children of a node are keyed by their distance to it."""

    def __init__(self, radius: int):
        self.radius = radius
        self.nodes: list[int] = []
        self.children: list[dict[int, int]] = []

    def near(self, value: int) -> Iterator[int]:
        """Places of nodes within the radius."""
        todo = [0] if self.nodes else []
        while todo:
            at = todo.pop()
            distance = (self.nodes[at] ^ value).bit_count()
            if distance <= self.radius:
                yield at
            for edge, child in self.children[at].items():
                if distance - self.radius <= edge <= distance + self.radius:
                    todo.append(child)

    def add(self, value: int) -> int:
        at, new = 0, len(self.nodes)
        self.nodes.append(value)
        self.children.append({})
        while new:
            distance = (self.nodes[at] ^ value).bit_count()
            if distance not in self.children[at]:
                self.children[at][distance] = new
                break
            at = self.children[at][distance]
        return new


def forest(values: list[int], radius: int) -> list[tuple[int, int]]:
    """Links that join exactly the values reachable from one another inside one shard."""
    tree, parent, links = BKTree(radius), [], []
    sets = 0

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for value in values:
        joined: set[int] = set()
        for at in tree.near(value):
            top = root(at)
            if top not in joined:
                joined.add(top)
                links.append((tree.nodes[at], value))
                if len(joined) == sets:  # all there is to join
                    break
        new = tree.add(value)
        parent.append(new)
        for top in joined:
            parent[top] = new
        sets += 1 - len(joined)
    return links


def shard_links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``a``, ``b``: links among distinct fingerprints, a spanning forest for every shard."""
    if not 0 <= radius <= 3:
        raise ValueError("four bands find pairs that differ in three bits at most")
    fp = F.col("fp")
    keys = []
    for band in range(4):
        value = F.shiftrightunsigned(fp, 16 * band).bitwiseAND(0xFFFF)
        low = fp.bitwiseAND((1 << (16 * band)) - 1)
        high = F.shiftleft(F.shiftrightunsigned(fp, 16 * (band + 1)), 16 * band) if band < 3 else F.lit(0).cast("long")
        rest = low.bitwiseOR(high)
        for sub in range(4):
            part = F.shiftrightunsigned(rest, 12 * sub).bitwiseAND(0xFFF)
            head = F.lit(band * 4 + sub).cast("long")
            keys.append(F.shiftleft(head, 28).bitwiseOR(F.shiftleft(value, 12)).bitwiseOR(part))
    sharded = distinct.select(F.explode(F.array(*keys)).alias("shard"), "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_keys, kept_fps = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def links(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
            edges = np.flatnonzero(np.diff(keys)) + 1
            bounds = np.concatenate([[0], edges, [len(keys)]])
            out: list[tuple[int, int]] = []
            for i in np.flatnonzero(np.diff(bounds) > 1).tolist():
                out += forest(fps[bounds[i] : bounds[i + 1]].view(np.uint64).tolist(), radius)
            pairs = np.array(out, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

        for batch in batches:
            keys = np.concatenate([kept_keys, batch.column(0).to_numpy()])
            fps = np.concatenate([kept_fps, batch.column(1).to_numpy()])
            if not len(keys):
                continue
            whole = int(np.searchsorted(keys, keys[-1]))  # the last shard may go on in the next batch
            kept_keys, kept_fps = keys[whole:], fps[whole:]
            if whole:
                yield links(keys[:whole], fps[:whole])
        if len(kept_keys):
            yield links(kept_keys, kept_fps)

    return sharded.repartition("shard").sortWithinPartitions("shard").mapInArrow(run, "a long, b long")


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, radius: int = RADIUS, seed: int = SEED
) -> DataFrame:
    """``key``, ``fingerprint`` (16 hex digits), ``component_id``: the least key reachable over links."""
    prints = written(fingerprints(docs, key, text, size, seed), "simhash")
    firsts = written(prints.groupBy("fp").agg(F.min(key).alias("first")), "simhash-distinct")
    linked = components(shard_links(firsts.select("fp"), radius), "a", "b", "simhash-links")
    rooted = firsts.join(linked, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    rooted = written(rooted, "simhash-roots")
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = written(rooted.join(named, "root").select("fp", "component_id"), "simhash-named")
    return prints.join(named, "fp").select(
        key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_of_each(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows whose id is the least of their component, identical rows once, with the columns they came with.

    The ids that stay are few enough to be sent everywhere or else joined, so texts move
    only where an id occurs more than once.
    """
    groups = written(near_duplicates(docs, key), "simhash-groups")
    first = groups.where(F.col(key).eqNullSafe(F.col("component_id"))).groupBy(F.col(key).alias("first")).agg((F.count("*") > 1).alias("several"))
    first = written(first, "simhash-first")
    stays = lambda side: docs[key].eqNullSafe(side["first"])
    once = written_side(first.where("not several").select("first"), "simhash-once")
    several = written_side(first.where("several").select("first"), "simhash-several")
    kept = docs.join(once, stays(once), "left_semi")
    return kept.unionByName(docs.join(several, stays(several), "left_semi").dropDuplicates([key, "text"]))
