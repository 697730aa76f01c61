"""Alignment of two tokenizations of each text, composed from fragments.

Byte offsets where a token of both sides ends cut a text into groups. A stretch of a text
is a fragment: an open prefix up to its first cut, closed groups, and an open suffix after
its last. Fragments compose: the suffix of one and the prefix of the next are put end to
end, cuts that only the two together have are found there, and what lies between cuts is
closed. This is associative, since the cuts of a whole are those of its token ends however
it was bracketed. Texts above ``CHUNK`` characters are cut into chunks, each side at places
where that side's tokens always end, which need not be the same; chunks are tokenized in
different tasks and their fragments composed as a tree of ``FAN`` children, a written table
per level. Closed groups leave a fragment as soon as they are closed, so a fragment holds
open ends only, and a last sorted pass streams a text's closed groups into its digest.

Tokens that share a group are linked. Links are counted within a document as distinct pairs
of ids with their number, and across documents by one aggregation over those pairs. The
counts are broadcast where they are few enough, else joined by shuffle.

Defined results: a null or empty text, and one whose tokens' bytes are not the text behind
one space on both sides, has no tokens, zero counts and an empty digest. Special tokens'
strings are plain text. Repeated rows and repeated or null keys are rows of their own, and
each counts as a document. Ties for an id's highest count are all best. An empty table gives
an empty result. Columns other than the key and the text are not read. A text without a
place to cut is one chunk, whatever its length.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from qaloom.lineage import written, written_side
from qaloom.llm.batches import blocks
from qaloom.llm.bpe import SPLIT, byte_letters, vocabulary_text

CHUNK = 1 << 15  # characters of a chunk; texts up to this length are aligned whole
FAN = 8  # fragments that one composition takes
WIDE = 256  # token pairs of a group beyond which its ids are counted before they are paired
BITS = 21  # of one id in a pair

# Places where a byte-level tokenizer's pieces always end: before white space behind a visible
# ASCII character, since its pattern never carries white space inside a piece.
BYTE_CUT = re.compile(r"(?<=[!-~])[ \n]")
# Where a piece tokenizer's pieces always end: before a space that starts a run of them, as
# long as no piece of the vocabulary holds the mark of a space behind another character.
PIECE_CUT = re.compile(r"(?<=[^ ▁]) (?=.)", re.DOTALL)
MARK = "▁"


@dataclass
class Side:
    """One tokenizer: ids of texts, the bytes of every id, and where texts may be cut."""

    encode: Callable[[list[str]], list[np.ndarray]]
    tokens: list[bytes]
    cut: re.Pattern | None

    def __post_init__(self):
        if len(self.tokens) > 1 << BITS:
            raise ValueError(f"more than {1 << BITS} ids")
        self.lengths = np.array([len(t) for t in self.tokens], np.int64)
        self.table = pa.array(self.tokens, pa.large_binary())

    def joined(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Bytes of the ids end to end, and the offset of each and of the end."""
        return taken(self.table, ids)


def taken(table: pa.Array, places: np.ndarray) -> tuple[bytes, np.ndarray]:
    if not len(places):
        return b"", np.zeros(1, np.int64)
    out = table.take(pa.array(places))
    offsets = np.frombuffer(out.buffers()[1], np.int64)[: len(out) + 1]
    return out.buffers()[2].to_pybytes()[: offsets[-1]], offsets


def byte_side(file_text: str) -> Side:
    """A byte-level tokenizer file; a special token's string is plain text."""
    import tiktoken

    data = json.loads(file_text)
    special = {t["content"] for t in data["added_tokens"]}
    letters = byte_letters()
    vocab = data["model"]["vocab"]
    ranks = {bytes(letters[c] for c in token): i for token, i in vocab.items() if token not in special}
    merged = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in data["model"]["merges"]]
    # Merging by id is merging by rank only if ids follow the merge list and leave nothing out.
    if merged != sorted(merged) or len(set(merged)) + 256 != len(ranks):
        raise ValueError("ids do not follow the order of merges")
    encoding = tiktoken.Encoding("byte level", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
    tokens = [b""] * (max(vocab.values()) + 1)
    for token, i in ranks.items():
        tokens[i] = token

    def encode(texts: list[str]) -> list[np.ndarray]:
        return [encoding.encode_to_numpy(t, allowed_special=set(), disallowed_special=()).astype(np.int64) for t in texts]

    return Side(encode, tokens, BYTE_CUT)


def piece_side(model: bytes) -> Side:
    """A piece model with byte fallback that puts a space in front; texts come with that space."""
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_proto=model)
    pieces = [processor.id_to_piece(i) for i in range(processor.get_piece_size())]
    tokens = [bytes([int(p[3:5], 16)]) if processor.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
    crossing = any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces)

    def encode(texts: list[str]) -> list[np.ndarray]:
        return [np.array(ids, np.int64) for ids in processor.encode([t[1:] for t in texts], num_threads=1)]

    return Side(encode, tokens, None if crossing else PIECE_CUT)


class Aligner:
    """Both sides, and the text of a group list."""

    def __init__(self, a: Side, b: Side):
        self.sides = a, b
        words = [f"{i}{end}".encode() for side, ends in ((a, ",|"), (b, ",;")) for i in range(len(side.tokens)) for end in ends]
        self.words = pa.array(words, pa.large_binary())

    def linked(self, a: np.ndarray, ga: np.ndarray, b: np.ndarray, gb: np.ndarray, owner: np.ndarray, n: int) -> dict:
        """Counts, group text and pairs of each of ``n`` owners.

        ``ga`` and ``gb`` are the tokens' groups and ``owner`` the groups' owners, all rising.
        """
        na, nb = np.bincount(ga, minlength=len(owner)), np.bincount(gb, minlength=len(owner))
        after_a, after_b = np.cumsum(na), np.cumsum(nb)
        first_b = after_b - nb
        at_a = np.arange(len(a))
        codes = np.empty(len(a) + len(b), np.int64)
        codes[at_a + first_b[ga]] = 2 * a + (at_a == after_a[ga] - 1)
        at_b = np.arange(len(b))
        codes[at_b + after_a[gb]] = 2 * (len(self.sides[0].tokens) + b) + (at_b == after_b[gb] - 1)
        text, offsets = taken(self.words, codes)
        total = lambda x: np.bincount(owner, x, n).astype(np.int64)
        out = {"n_a": total(na), "n_b": total(nb), "n_groups": np.bincount(owner, minlength=n), "n_links": total(na * nb)}
        ends = offsets[np.cumsum(out["n_a"] + out["n_b"])]
        # The last separator of an owner's groups is no part of its text.
        out["text"] = [text[i : max(i, j - 1)] for i, j in zip([0, *ends[:-1].tolist()], ends.tolist())]
        keys, times = self.pairs(a, ga, b, first_b, na, nb, owner)
        split = np.searchsorted(keys >> 2 * BITS, np.arange(n + 1))
        return out | {"split": split, "pairs": keys & ((1 << 2 * BITS) - 1), "times": times}

    @staticmethod
    def pairs(a, ga, b, first_b, na, nb, owner) -> tuple[np.ndarray, np.ndarray]:
        """Distinct owner and id pairs in one number each, and how often each is linked."""
        wide = na * nb > WIDE
        reach = np.where(wide, 0, nb)[ga]
        ia = np.repeat(np.arange(len(a)), reach)
        step = np.arange(len(ia)) - np.repeat(np.cumsum(reach) - reach, reach)
        keys = owner[ga[ia]] << 2 * BITS | a[ia] << BITS | b[first_b[ga[ia]] + step]
        if not wide.any():
            return np.unique(keys, return_counts=True)
        parts = [np.unique(keys, return_counts=True)]
        first_a = np.cumsum(na) - na
        for g in np.flatnonzero(wide):
            ua, ca = np.unique(a[first_a[g] : first_a[g] + na[g]], return_counts=True)
            ub, cb = np.unique(b[first_b[g] : first_b[g] + nb[g]], return_counts=True)
            parts.append(((owner[g] << 2 * BITS | ua[:, None] << BITS | ub[None, :]).ravel(), (ca[:, None] * cb[None, :]).ravel()))
        return summed(parts)

    def whole(self, texts: list[str | None]) -> dict:
        """``linked`` of whole texts, each an owner."""
        spaced = [" " + t if t else "" for t in texts]
        some = [i for i, t in enumerate(spaced) if t]
        ids = [side.encode([spaced[i] for i in some]) for side in self.sides]
        good = np.ones(len(some), bool)
        for side, lists in zip(self.sides, ids):
            counts = np.cumsum([0, *map(len, lists)])
            data, offsets = side.joined(np.concatenate([np.zeros(0, np.int64), *lists]))
            ends = offsets[counts]
            for k, i in enumerate(some):
                good[k] &= data[ends[k] : ends[k + 1]] == spaced[i].encode()
        some = np.array(some, np.int64)[good]
        a, b = (np.concatenate([np.zeros(0, np.int64), *(x for x, ok in zip(lists, good) if ok)]) for lists in ids)
        ends_a, ends_b = (np.cumsum(side.lengths[x]) for side, x in zip(self.sides, (a, b)))
        cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
        last = np.cumsum([len(spaced[i].encode()) for i in some])
        owner = some[np.searchsorted(last, cuts)] if len(cuts) else np.zeros(0, np.int64)
        return self.linked(a, np.searchsorted(cuts, ends_a), b, np.searchsorted(cuts, ends_b), owner, len(texts))

    def run(self, a: Tokens, b: Tokens, cuts: np.ndarray) -> dict | None:
        """One row of closed groups that end at the given cuts."""
        if not len(cuts):
            return None
        got = self.linked(a.ids, np.searchsorted(cuts, a.ends), b.ids, np.searchsorted(cuts, b.ends), np.zeros(len(cuts), np.int64), 1)
        row = {k: int(got[k][0]) for k in COUNTS}
        return row | {"at": int(cuts[0]), "text": got["text"][0], "pairs": got["pairs"], "times": got["times"]}


def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, times = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(keys, kind="stable")
    keys, times = keys[order], times[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(times, first) if len(first) else times


COUNTS = ["n_a", "n_b", "n_groups", "n_links"]


@dataclass
class Tokens:
    """Consecutive tokens of one side and the byte offsets where they end."""

    ids: np.ndarray
    ends: np.ndarray

    def between(self, low: int, high: int) -> Tokens:
        """Tokens that end after ``low`` and not after ``high``."""
        i, j = np.searchsorted(self.ends, [low, high], side="right")
        return Tokens(self.ids[i:j], self.ends[i:j])

    def __add__(self, other: Tokens) -> Tokens:
        return Tokens(np.concatenate([self.ids, other.ids]), np.concatenate([self.ends, other.ends]))


NOTHING = Tokens(np.zeros(0, np.int64), np.zeros(0, np.int64))
FAR = np.iinfo(np.int64).max


@dataclass
class Fragment:
    """Open ends of a stretch. Without a cut all tokens stand in the head."""

    cut: bool
    bad: bool
    head: tuple[Tokens, Tokens]
    tail: tuple[Tokens, Tokens] = (NOTHING, NOTHING)

    PARTS = ["head_a", "head_b", "tail_a", "tail_b"]

    def row(self) -> dict:
        parts = zip(self.PARTS, (*self.head, *self.tail))
        return {"cut": self.cut, "bad": self.bad} | {f"{p}_{k}": v for p, t in parts for k, v in (("ids", t.ids), ("ends", t.ends))}

    @classmethod
    def of(cls, row: dict) -> Fragment:
        t = [Tokens(np.array(row[f"{p}_ids"], np.int64), np.array(row[f"{p}_ends"], np.int64)) for p in cls.PARTS]
        return cls(row["cut"], row["bad"], (t[0], t[1]), (t[2], t[3]))


Closed = tuple[Tokens, Tokens, np.ndarray]


def fragment(a: Tokens, b: Tokens) -> tuple[Fragment, Closed]:
    """The fragment of a stretch and its closed groups."""
    cuts = np.intersect1d(a.ends, b.ends, assume_unique=True)
    if not len(cuts):
        return Fragment(False, False, (a, b)), (NOTHING, NOTHING, cuts)
    first, last = cuts[0], cuts[-1]
    head, tail = (a.between(-1, first), b.between(-1, first)), (a.between(last, FAR), b.between(last, FAR))
    return Fragment(True, False, head, tail), (a.between(first, last), b.between(first, last), cuts[1:])


def compose(left: Fragment, right: Fragment) -> tuple[Fragment, Closed]:
    """The fragment of two neighbouring stretches, and the groups that closed between them."""
    bad = left.bad or right.bad
    open_end = left.tail if left.cut else left.head
    middle, (a, b, cuts) = fragment(open_end[0] + right.head[0], open_end[1] + right.head[1])
    if not middle.cut:
        if left.cut:
            return Fragment(True, bad, left.head, middle.head), (NOTHING, NOTHING, cuts)
        return Fragment(False, bad, middle.head), (NOTHING, NOTHING, cuts)
    # The head of ``right`` ends at a cut, so nothing stays open in front of its own tail.
    tail = right.tail if right.cut else middle.tail
    if not left.cut:
        return Fragment(True, bad, middle.head, tail), (a, b, cuts)
    first = middle.head[0].ends[-1:]
    return Fragment(True, bad, left.head, tail), (middle.head[0] + a, middle.head[1] + b, np.concatenate([first, cuts]))


def chunks(text: str, cuts: tuple[re.Pattern | None, re.Pattern | None], size: int) -> Iterator[tuple[int, int, list[int]]]:
    """Number, first byte and [from, to] of both sides of each chunk, in characters of the text."""
    here, byte, counted = [0, 0], 0, 0
    for number in range(-(-len(text) // size)):
        there = []
        for start, pattern in zip(here, cuts):
            found = pattern.search(text, max(start + 1, (number + 1) * size)) if pattern else None
            there.append(found.start() if found else len(text))
        if there != here:
            low = min(here)
            byte += len(text[counted:low].encode())
            counted = low
            yield number, byte, [here[0], there[0], here[1], there[1]]
        here = there


FRAGMENT = "cut boolean, bad boolean, " + ", ".join(f"{p}_{k} array<long>" for p in Fragment.PARTS for k in ("ids", "ends"))
RUN = "at long, n_a long, n_b long, n_groups long, n_links long, text binary, pairs array<long>, times array<long>"
LONGS = pa.list_(pa.int64())
ARROW_FRAGMENT = pa.struct([("cut", pa.bool_()), ("bad", pa.bool_()), *((f"{p}_{k}", LONGS) for p in Fragment.PARTS for k in ("ids", "ends"))])
ARROW_RUN = pa.struct([("at", pa.int64()), *((c, pa.int64()) for c in COUNTS), ("text", pa.binary()), ("pairs", LONGS), ("times", LONGS)])


class Alignment:
    """The operator over one table; tokenizer files travel as broadcasts of their own size."""

    def __init__(self, spark: SparkSession, byte_path: str, piece_path: str, chunk: int = CHUNK, fan: int = FAN):
        shared = spark.sparkContext.broadcast((vocabulary_text(spark, byte_path), file_bytes(spark, piece_path)))
        self.aligner = lambda: Aligner(byte_side(shared.value[0]), piece_side(shared.value[1]))
        self.chunk, self.fan = chunk, fan

    def short(self, docs: DataFrame, kind: str) -> DataFrame:
        """``uid``, ``doc``, counts, digest and pairs of texts that are aligned whole."""
        make = self.aligner

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            aligner = make()
            for batch in batches:
                for part, _, _ in blocks(batch, "text"):
                    got = aligner.whole(part.column("text").to_pylist())
                    digests = [hashlib.sha256(t).hexdigest() if t else "" for t in got["text"]]
                    split = pa.array(got["split"].astype(np.int32))
                    lists = [pa.ListArray.from_arrays(split, pa.array(got[c].astype(np.int64))) for c in ("pairs", "times")]
                    columns = [*part.columns[:2], *(pa.array(got[c].astype(np.int64)) for c in COUNTS), pa.array(digests, pa.string()), *lists]
                    yield pa.RecordBatch.from_arrays(columns, ["uid", "doc", *COUNTS, "groups_sha256", "pairs", "times"])

        schema = f"uid long, doc {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"
        return docs.mapInArrow(run, schema)

    def cut(self, docs: DataFrame, kind: str) -> DataFrame:
        """Chunks of long texts: a slice of the text, its first byte, and both sides' places in it."""
        make, size = self.aligner, self.chunk

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            aligner = None
            for batch in batches:
                aligner = aligner or make()
                patterns = tuple(side.cut for side in aligner.sides)
                for uid, doc, text in zip(batch.column("uid"), batch.column("doc"), batch.column("text")):
                    spaced = " " + text.as_py()
                    for number, byte, sides in chunks(spaced, patterns, size):
                        low, high = min(sides), max(sides)
                        columns = [
                            pa.array([uid.as_py()], pa.int64()), pa.array([doc.as_py()], doc.type), pa.array([number], pa.int64()),
                            pa.array([byte], pa.int64()), pa.array([spaced[low:high]], pa.string()), pa.array([[s - low for s in sides]], LONGS),
                        ]
                        yield pa.RecordBatch.from_arrays(columns, ["uid", "doc", "number", "byte", "text", "sides"])

        return docs.mapInArrow(run, f"uid long, doc {kind}, number long, byte long, text string, sides array<long>")

    def fragments(self, pieces: DataFrame, kind: str) -> DataFrame:
        """One fragment per chunk, and a row of its closed groups."""
        make = self.aligner

        def rows(batch: pa.RecordBatch, aligner: Aligner) -> Iterator[tuple]:
            for row in batch.to_pylist():
                tokens, bad = [], False
                for side, (start, stop) in zip(aligner.sides, (row["sides"][:2], row["sides"][2:])):
                    text = row["text"][start:stop]
                    ids = side.encode([text])[0] if text else NOTHING.ids
                    bad |= side.joined(ids)[0] != text.encode()
                    base = row["byte"] + len(row["text"][:start].encode())
                    tokens.append(Tokens(ids, base + np.cumsum(side.lengths[ids])))
                if bad:
                    yield row, Fragment(False, True, (NOTHING, NOTHING)), None
                else:
                    piece, closed = fragment(*tokens)
                    yield row, piece, aligner.run(*closed)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            aligner = None
            for batch in batches:
                aligner = aligner or make()
                for i in range(0, batch.num_rows, 32):
                    part = batch.slice(i, 32)
                    yield state(rows(part, aligner), part.schema.field("doc").type)

        return pieces.mapInArrow(run, state_schema(kind))

    def level(self, parts: DataFrame, kind: str, last: bool) -> DataFrame:
        """Up to ``FAN`` neighbouring fragments composed into one; the last level closes the head."""
        make, fan = self.aligner, self.fan
        grouped = parts.groupBy("uid", "doc", F.expr(f"number div {fan}").alias("number")).agg(
            F.sort_array(F.collect_list(F.struct(F.col("number").alias("n"), "fragment"))).alias("parts")
        )

        def rows(batch: pa.RecordBatch, aligner: Aligner) -> Iterator[tuple]:
            for row in batch.to_pylist():
                whole, closed = None, []
                for part in row["parts"]:
                    piece = Fragment.of(part["fragment"])
                    if whole is None:
                        whole = piece
                        continue
                    whole, groups = compose(whole, piece)
                    closed.append(aligner.run(*groups))
                if last:
                    # The text starts and ends with a cut, so its head is a group and nothing else is open.
                    whole.bad |= not whole.cut or any(len(t.ids) for t in whole.tail)
                    if not whole.bad:
                        closed.append(aligner.run(*whole.head, whole.head[0].ends[-1:]))
                yield row, whole, None
                for run in closed:
                    if run is not None:
                        yield row, None, run

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            aligner = None
            for batch in batches:
                aligner = aligner or make()
                for i in range(0, batch.num_rows, 32):
                    part = batch.slice(i, 32)
                    yield state(rows(part, aligner), part.schema.field("doc").type)

        return grouped.mapInArrow(run, state_schema(kind))

    def long(self, docs: DataFrame, kind: str) -> tuple[DataFrame, DataFrame] | None:
        """Counts and digest of every long text, and its pairs; None if there is none."""
        pieces = written(self.cut(docs, kind), "alignment-chunks")
        n, top = pieces.agg(F.count("*"), F.max("number")).first()
        if not n:
            return None
        # A chunk is a few tokenizer calls of work, so chunks are dealt out by number, not by bytes.
        level = written(self.fragments(pieces.repartition(max(1, -(-n // 64))), kind), "alignment-fragments")
        runs = [level]
        while True:
            top //= self.fan
            level = written(self.level(level.where("fragment is not null").select("uid", "doc", "number", "fragment"), kind, top == 0), "alignment-level")
            runs.append(level)
            if top == 0:
                break
        ends = level.where("fragment is not null").select("uid", "doc", "fragment.bad")
        union = runs[0]
        for more in runs[1:]:
            union = union.unionByName(more)
        closed = union.where("run is not null").select("uid", "doc", "run.*").join(ends.where("not bad").select("uid"), "uid", "left_semi")
        zeros = ends.where("bad").select("uid", "doc", *(F.lit(0).cast("long").alias(c) for c in COUNTS), F.lit("").alias("groups_sha256"))
        counted = (
            closed.drop("pairs", "times").repartition("uid").sortWithinPartitions("uid", "at").mapInArrow(digested, f"uid long, doc {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string")
        )
        pairs = exploded(closed).groupBy("uid", "pair").agg(F.sum("times").alias("times"))
        return counted.unionByName(zeros), pairs


def exploded(rows: DataFrame) -> DataFrame:
    return rows.select("uid", F.inline(F.arrays_zip("pairs", "times"))).withColumnRenamed("pairs", "pair")


def state_schema(kind: str) -> str:
    return f"uid long, doc {kind}, number long, fragment struct<{FRAGMENT.replace(' ', ':').replace(',:', ', ')}>, run struct<{RUN.replace(' ', ':').replace(',:', ', ')}>"


def state(rows: Iterable[tuple], doc: pa.DataType) -> pa.RecordBatch:
    """Rows of one level: (row, fragment or None, run or None)."""
    flat = []
    for row, piece, run in rows:
        own = (row["uid"], row["doc"], row["number"])
        if piece is not None and run is not None:
            flat += [(*own, piece.row(), None), (*own, None, run)]
        else:
            flat.append((*own, piece and piece.row(), run))
    columns = list(zip(*flat)) if flat else [[], [], [], [], []]
    kinds = [pa.int64(), doc, pa.int64(), ARROW_FRAGMENT, ARROW_RUN]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], ["uid", "doc", "number", "fragment", "run"])


def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted runs in, one row per text out; a text's groups pass through its hash one run at a time."""
    doc_type, open_row, out = None, None, []

    def finished(rows: list[dict]) -> pa.RecordBatch:
        names = ["uid", "doc", *COUNTS, "groups_sha256"]
        kinds = [pa.int64(), doc_type, *[pa.int64()] * 4, pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, kinds)], names)

    for batch in batches:
        doc_type = batch.schema.field("doc").type
        for row in batch.to_pylist():
            if open_row is None or open_row["uid"] != row["uid"]:
                if open_row is not None:
                    out.append(open_row | {"groups_sha256": open_row["sha"].hexdigest()})
                open_row = {"uid": row["uid"], "doc": row["doc"], "sha": hashlib.sha256(row["text"])} | {c: row[c] for c in COUNTS}
            else:
                open_row["sha"].update(b";" + row["text"])
                open_row |= {c: open_row[c] + row[c] for c in COUNTS}
        if out:
            yield finished(out)
            out = []
    if open_row is not None:
        yield finished([open_row | {"groups_sha256": open_row["sha"].hexdigest()}])


def file_bytes(spark: SparkSession, path: str) -> bytes:
    """A small file, read where the driver runs or through Spark."""
    if "://" not in path:
        with open(path, "rb") as f:
            return f.read()
    return bytes(spark.read.format("binaryFile").load(path).first().content)


def aligned(docs: DataFrame, byte_path: str, piece_path: str, key: str = "doc_id", text: str = "text", chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """``key``, ``n_a n_b n_groups n_links n_best count_sum groups_sha256`` of every text."""
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    work = Alignment(spark, byte_path, piece_path, chunk, fan)
    size = F.coalesce(F.length(text), F.lit(0))
    # Rows are told apart by an even number where they are aligned whole, by an odd one elsewhere.
    narrow = lambda odd: (F.monotonically_increasing_id() * 2 + odd).alias("uid")
    rows = lambda part, odd: part.select(narrow(odd), F.col(key).alias("doc"), F.col(text).cast("string").alias("text"))
    short = written(work.short(rows(docs.where(size <= chunk), 0), kind), "alignment-short")
    report, pairs = short.drop("pairs", "times"), exploded(short)
    if (long := work.long(rows(docs.where(size > chunk), 1), kind)) is not None:
        long_report, long_pairs = (written(x, "alignment-long") for x in long)
        report, pairs = report.unionByName(long_report), pairs.unionByName(long_pairs.select(*pairs.columns))
    counts = written(pairs.groupBy("pair").agg(F.count("*").alias("n")), "alignment-counts")
    counts = counts.withColumn("a", F.shiftright("pair", BITS))
    highest = counts.groupBy("a").agg(F.max("n").alias("highest"))
    side = written_side(counts.join(highest, "a").select("pair", "n", (F.col("n") == F.col("highest")).alias("best")), "alignment-best")
    sums = (
        pairs.join(side, "pair")
        .groupBy("uid")
        .agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    )
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return report.join(sums, "uid", "left").select(F.col("doc").alias(key), *COUNTS, zero("n_best"), zero("count_sum"), "groups_sha256")
