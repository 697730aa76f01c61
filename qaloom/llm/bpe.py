"""Byte-pair encoding and decoding as streaming transducers with bounded lookahead.

Merges run in the order of their list, so what follows a text can change its tokens only
through a chain of merges of rising rank, each one touching the left end of the one
before. ``lookahead`` is the longest such chain in bytes, computed from the merge list
alone. A token that ends more than that many bytes before the end of the window cannot
change any more: it is emitted, and the window goes on from its end. Memory is the
window, not the text. Decoding maps ids to bytes and feeds an incremental UTF-8 machine.

Defined results: a null text is the empty text and has no tokens; a special token inside
a text is that token, as the tokenizers library has it; an id outside the vocabulary
decodes to nothing. Repeated rows give repeated results, an empty table an empty one, and
no column but the text is read.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
from array import array
from collections.abc import Iterable, Iterator
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

# Fixed value: the split pattern of byte-level tokenizers.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

CHUNK = 1 << 16  # characters split at once
HELD_BACK = 4  # characters at a chunk's end that may still join a contraction
WINDOW = 1 << 12  # bytes beyond the lookahead in one merge window
CACHE = 250_000  # pieces of one generation whose tokens are remembered
SHORT = 48  # bytes up to which scanning all pairs beats a heap
PLAIN = 200  # characters up to which a piece is worth remembering
NONE = 1 << 60  # no merge; ids have up to 17 bits


def byte_letters() -> dict[str, int]:
    """The printable letter of every byte, as byte-level vocabularies write it."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """Ids, byte strings and merges of a byte-level tokenizer file; its size is the file's."""

    def __init__(self, text: str):
        data = json.loads(text)
        letters = byte_letters()
        model = data["model"]
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.bytes_of: dict[int, bytes] = {
            i: bytes(letters[c] for c in token) for token, i in model["vocab"].items() if token not in self.special
        }
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        vocab = model["vocab"]
        self.merges = []
        for pair in model["merges"]:
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merges.append((vocab[left], vocab[right], vocab[left + right]))
        # Pair of ids -> rank and new id in one number, so that the least number is the next merge.
        self.pairs = {a << 17 | b: rank << 17 | c for rank, (a, b, c) in reversed(list(enumerate(self.merges)))}
        self.byte_ids = [vocab[c] for c, _ in sorted(letters.items(), key=lambda item: item[1])]
        self.lookahead = self.sufficient_lookahead()
        self.split = regex.compile(SPLIT)
        self.special_split = (
            regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
            if self.special
            else None
        )
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def sufficient_lookahead(self) -> int:
        """Bytes to the right of a token boundary beyond which nothing can move it.

        Merge (c, d) at a place whose right end is in doubt moves the doubt to the start of
        c. The next merge of the chain has a higher rank and a right part that is c, or a
        token grown from cd to the right. Going down the ranks, ``as_right[t]`` is the
        longest reach of merges with right part t and ``grown[t]`` the longest over all
        tokens that t grows into.
        """
        as_right: dict[int, int] = {}
        grown: dict[int, int] = {}
        longest = 1
        for left, right, whole in reversed(self.merges):
            beyond = max(as_right.get(whole, 0), grown.get(whole, 0))
            reach = len(self.bytes_of[left]) + max(as_right.get(left, 0), beyond)
            as_right[right] = max(as_right.get(right, 0), reach)
            grown[left] = max(grown.get(left, 0), beyond)
            longest = max(longest, reach)
        return longest + max(map(len, self.bytes_of.values()))

    def merged(self, ids: list[int]) -> list[int]:
        """All merges over one window, lowest rank first, leftmost of equal ranks first."""
        get = self.pairs.get
        if len(ids) <= SHORT:
            found = [get(a << 17 | b, NONE) for a, b in zip(ids, ids[1:])]
            while found:
                best = min(found)
                if best == NONE:
                    break
                at = found.index(best)
                ids[at] = best & 0x1FFFF
                del ids[at + 1], found[at]
                if at:
                    found[at - 1] = get(ids[at - 1] << 17 | ids[at], NONE)
                if at < len(found):
                    found[at] = get(ids[at] << 17 | ids[at + 1], NONE)
            return ids
        n = len(ids)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(best, i) for i in range(n - 1) if (best := get(ids[i] << 17 | ids[i + 1], NONE)) != NONE]
        heapq.heapify(heap)
        while heap:
            best, i = heapq.heappop(heap)
            if not alive[i] or (j := after[i]) >= n or get(ids[i] << 17 | ids[j]) != best:
                continue
            ids[i], alive[j], after[i] = best & 0x1FFFF, False, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (best := get(ids[i] << 17 | ids[after[i]], NONE)) != NONE:
                    heapq.heappush(heap, (best, i))
            if before[i] >= 0 and (best := get(ids[before[i]] << 17 | ids[i], NONE)) != NONE:
                heapq.heappush(heap, (best, before[i]))
        return [t for t, here in zip(ids, alive) if here]

    def tokens(self, piece: bytes) -> list[int]:
        """Tokens of one piece; a long one goes through a window that keeps its lookahead."""
        if len(piece) <= self.lookahead + WINDOW:
            return self.merged([self.byte_ids[b] for b in piece])
        out: list[int] = []
        start = 0
        size = self.lookahead + WINDOW
        while start < len(piece):
            window = piece[start : start + size]
            ids = self.merged([self.byte_ids[b] for b in window])
            if start + size >= len(piece):
                out += ids
                break
            done, stable = 0, len(window) - self.lookahead
            for token in ids:
                step = len(self.bytes_of[token])
                if done + step > stable:
                    break
                out.append(token)
                done += step
            start += done
        return out

    def pieces(self, text: str) -> Iterator[str]:
        """Pieces of the split pattern, chunk by chunk: those that can still change are held back."""
        start, size = 0, CHUNK
        while start < len(text):
            last = start + size >= len(text)
            kept = start
            for found in self.split.finditer(text, start, min(len(text), start + size)):
                if not last and found.end() > start + size - HELD_BACK:
                    break
                yield found.group()
                kept = found.end()
            if last:
                return
            size = CHUNK if kept > start else 2 * size
            start = kept

    def remember(self, part: str, ids: bytes) -> bytes:
        """Two generations of bounded size: what is used again moves to the younger one."""
        if len(part) <= PLAIN:
            if len(self.young) >= CACHE:
                self.old, self.young = self.young, {}
            self.young[part] = ids
        return ids

    def of_piece(self, piece: str) -> bytes:
        known = self.young.get(piece)
        if known is None:
            known = self.old.get(piece)
            if known is None:
                known = array("I", self.tokens(piece.encode())).tobytes()
            self.remember(piece, known)
        return known

    def of_part(self, part: str) -> bytes:
        known = self.old.get(part)
        if known is None:
            own = self.split.findall(part) if len(part) <= PLAIN else self.pieces(part)
            known = b"".join(map(self.of_piece, own))
        return self.remember(part, known)

    def plain(self, text: str, out: list[bytes]) -> None:
        """Append the tokens of a text without special tokens.

        A single space before a letter always begins a piece, so a text without space runs
        is looked up by its space-separated parts; the others go piece by piece.
        """
        if "  " in text or text.endswith(" ") or text.startswith(" "):
            out.extend(map(self.of_piece, self.pieces(text)))
            return
        head, *rest = text.split(" ")
        out.extend(map(self.of_piece, self.pieces(head)))
        for part in rest:
            part = " " + part
            out.append(self.young.get(part) or self.of_part(part))

    def encode(self, text: str | None) -> memoryview:
        """Ids of a text as 32-bit unsigned numbers; special tokens in it stand for themselves."""
        out: list[bytes] = []
        if text:
            if self.special_split is None or not any(s in text for s in self.special):
                self.plain(text, out)
            else:
                for part in self.special_split.split(text):
                    if part in self.special:
                        out.append(array("I", [self.special[part]]).tobytes())
                    elif part:
                        self.plain(part, out)
        return memoryview(b"".join(out)).cast("I")

    def decoded(self, ids: Iterable[int], step: int = 1 << 13) -> Iterator[str]:
        """The text of ids, piece by piece; a broken byte sequence becomes U+FFFD."""
        machine = codecs.getincrementaldecoder("utf-8")(errors="replace")
        get, nothing, rest = self.bytes_of.get, repeat(b""), iter(ids)
        while some := list(islice(rest, step)):
            yield machine.decode(b"".join(map(get, some, nothing)))
        yield machine.decode(b"", True)


def vocabulary_text(spark: SparkSession, path: str) -> str:
    """A tokenizer file's text, read where the driver runs or through Spark."""
    if "://" not in path:
        with open(path, encoding="utf-8") as f:
            return f.read()
    return spark.read.text(path, wholetext=True).first()[0]


def id_lists(ids: list[memoryview]) -> pa.ListArray:
    offsets = np.cumsum([0, *map(len, ids)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), np.int32)))


def encode(docs: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with ``out``, the ids of its text; every other column is kept."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary_text(docs.sparkSession, path))

    def run(batches):
        vocabulary = Vocabulary(shared.value)
        for batch in batches:
            for row in range(0, batch.num_rows, 512):
                part = batch.slice(row, 512)
                lists = id_lists([vocabulary.encode(t) for t in part.column(text).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns, lists], [*part.schema.names, out])

    from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

    clash = [c for c in docs.columns if c.lower() == out.lower()]
    if clash:
        raise ValueError(f"column {out} exists; name another with out=")
    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(out, ArrayType(IntegerType()))]))


def decode(encoded: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``encoded`` with ``out``, the text of its ids."""
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary_text(encoded.sparkSession, path))

    def run(batches):
        vocabulary = Vocabulary(shared.value)
        for batch in batches:
            for row in range(0, batch.num_rows, 512):
                part = batch.slice(row, 512)
                texts = [None if i is None else "".join(vocabulary.decoded(i)) for i in part.column(ids).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*part.schema.names, out])

    from pyspark.sql.types import StringType, StructField, StructType

    if any(c.lower() == out.lower() for c in encoded.columns):
        raise ValueError(f"column {out} exists; name another with out=")
    return encoded.mapInArrow(run, StructType([*encoded.schema.fields, StructField(out, StringType())]))


DIGESTS = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def digests(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode and decode every text in one pass: count and hashes of both, and the ids if asked for."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary_text(docs.sparkSession, path))
    kind = docs.select(key).schema[0].dataType.simpleString()

    def run(batches):
        vocabulary = Vocabulary(shared.value)
        names = [key, "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids]
        for batch in (b.slice(row, 512) for b in batches for row in range(0, b.num_rows, 512)):
            counts, sums, texts, lists = [], [], [], []
            for value in batch.column(1):
                ids = vocabulary.encode(value.as_py())
                counts.append(len(ids))
                if with_ids:
                    lists.append(ids)
                sums.append(hashlib.sha256(ids.tobytes()).hexdigest())
                whole = hashlib.sha256()
                for piece in vocabulary.decoded(ids):
                    whole.update(piece.encode())
                texts.append(whole.hexdigest())
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(sums, pa.string()), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays([*columns, *[id_lists(lists)] * with_ids], names)

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, {DIGESTS}" + ", ids array<int>" * with_ids)
