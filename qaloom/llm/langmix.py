"""Language identification as a mixture of languages.

Every language is a model of hashed character n-grams of words, counted over all labelled
documents outside the held-out third. A document is a mixture: each of its words comes
from one language, and expectation-maximisation finds the proportions from the words'
n-gram likelihoods. The set of languages is chosen by penalised likelihood (half a log of
the word count per language): starting from all, the language with the smallest share is
dropped until that would make the penalised likelihood fall. Other removals are not tried,
and each maximisation ends after ``ROUNDS`` rounds or at ``SETTLED``, so the set of a mixed
document can differ from the best one.

Counting is one pass with partial sums per task, then one row per language and n-gram
slot; the model has ``SLOTS`` numbers per language. Scoring is one pass without shuffle.

Defined results: a null text, or one without a letter, is ``und`` with score 0; without
any labelled document so is every text. Ties go to the first language in order. An empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from qaloom.llm.batches import blocks, lowered, per_text, words
from qaloom.llm.registry import held_out

SIZES = (1, 2, 3, 4)  # bytes of an n-gram
SLOTS = 1 << 16
SMOOTH = 0.5
ROUNDS = 12
SETTLED = 1e-3  # a document whose proportions move less is done
LEAST_SHARE = 1e-4

# Bytes of letters: ASCII letters and every byte of longer characters.
LETTERS = np.zeros(256, bool)
LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
ANY_LETTER = regex.compile(r"\p{L}")


def gram_slots(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slot of every n-gram inside words with one blank on each side, the word of each, and the n + 1 word offsets."""
    small = lowered(raw)
    starts, ends, first = words(small, offsets, LETTERS)
    if not len(starts):
        empty = np.zeros(0, np.int64)
        return empty, empty, first
    lengths = ends - starts + 2
    edge = np.concatenate([[0], np.cumsum(lengths)])
    padded = np.full(edge[-1], 0x20, np.uint8)
    inside = LETTERS[small]
    shift = np.repeat(edge[:-1] + 1 - starts, lengths - 2)
    padded[np.flatnonzero(inside) + shift] = small[inside]
    word_of = np.repeat(np.arange(len(starts)), lengths)
    slots, owners = [], []
    for size in SIZES:
        count = len(padded) - size + 1
        if count <= 0:
            continue
        h = np.full(count, size, np.uint32)
        for j in range(size):
            h = h * np.uint32(0x01000193) + padded[j : j + count]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(13)
        own = word_of[:count] == word_of[size - 1 :]
        slots.append((h[own] & np.uint32(SLOTS - 1)).astype(np.int64))
        owners.append(word_of[:count][own])
    return np.concatenate(slots), np.concatenate(owners), first


def gram_counts(docs: DataFrame) -> DataFrame:
    """``lang``, ``slot``, ``n`` over all documents whose language may be learnt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for part, raw, offsets in blocks(batch):
                slots, owners, first = gram_slots(raw, offsets)
                langs = part.column("lang").to_pylist()
                text_of = np.repeat(np.arange(len(langs)), np.diff(first))[owners]
                names = sorted(set(langs))
                of_text = np.array([names.index(x) for x in langs])
                sums = np.bincount(of_text[text_of] * SLOTS + slots, minlength=len(names) * SLOTS).reshape(-1, SLOTS)
                for name, row in zip(names, sums):
                    totals[name] = totals.get(name, 0) + row
        for name, row in totals.items():
            own = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(own), pa.string()), pa.array(own.astype(np.int32)), pa.array(row[own].astype(np.int64))],
                ["lang", "slot", "n"],
            )

    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.coalesce(~held_out("doc_id"), F.lit(True)))
    counts = known.select("text", "lang").mapInArrow(run, "lang string, slot int, n long")
    return counts.groupBy("lang", "slot").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame) -> tuple[list[str], np.ndarray] | None:
    """Languages in order and their log likelihoods, SLOTS x languages; None without labels.

    What reaches the driver is SLOTS rows per language at most, whatever the corpus.
    """
    table = gram_counts(docs).toArrow()
    if not table.num_rows:
        return None
    langs = table["lang"].to_pylist()
    names = sorted(set(langs))
    at = {name: i for i, name in enumerate(names)}
    counts = np.full((SLOTS, len(names)), SMOOTH)
    counts[table["slot"].to_numpy(), [at[x] for x in langs]] += table["n"].to_numpy()
    return names, np.log(counts / counts.sum(axis=0)).astype(np.float32)


def mixture(like: np.ndarray, weight: np.ndarray, doc: np.ndarray, n: int, active: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of the active languages of n documents by expectation-maximisation, and the log likelihoods.

    ``like`` is words x languages, scaled so that the greatest of a word is 1.
    """
    total = np.maximum(np.bincount(doc, weight, minlength=n), 1e-12)
    share = share * active
    share /= np.maximum(share.sum(axis=1, keepdims=True), 1e-300)
    own, own_weight, own_doc, live = like, weight, doc, np.ones(n, bool)
    for _ in range(ROUNDS):
        joint = own * share[own_doc]
        joint *= (own_weight / np.maximum(joint.sum(axis=1), 1e-300))[:, None]
        new = np.stack([np.bincount(own_doc, joint[:, k], minlength=n) for k in range(like.shape[1])], axis=1) / total[:, None]
        new[~live] = share[~live]
        live &= np.abs(new - share).max(axis=1) > SETTLED
        share = new
        if not live.any():
            break
        going = live[own_doc]
        if 2 * np.count_nonzero(going) < len(going):  # settled documents need no more rounds
            own, own_weight, own_doc = own[going], own_weight[going], own_doc[going]
    evidence = np.log(np.maximum((like * share[doc]).sum(axis=1), 1e-300)) * weight
    return share, np.bincount(doc, evidence, minlength=n)


def proportions(slots: np.ndarray, owners: np.ndarray, first: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Language proportions of every text under the best penalised likelihood; zeros without words."""
    n, m, width = len(first) - 1, int(first[-1]), table.shape[1]
    if not m:
        return np.zeros((n, width))
    doc = np.repeat(np.arange(n), np.diff(first))
    log = np.stack([np.bincount(owners, table[slots, k], minlength=m) for k in range(width)], axis=1)
    # Overlapping n-grams tell the same letters again: a word's evidence is their mean.
    log /= len(SIZES)
    like = np.exp(np.maximum(log - log.max(axis=1, keepdims=True), -30))
    weight = np.ones(m)
    penalty = 0.5 * np.log(np.maximum(np.diff(first), 2))
    active = np.ones((n, width), bool)
    share, value = mixture(like, weight, doc, n, active, np.full((n, width), 1.0 / width))
    best, score = share, value - penalty * active.sum(axis=1)
    open_ = np.diff(first) > 0
    for _ in range(width - 1):
        todo = np.flatnonzero(open_)
        if not len(todo):
            break
        least = np.where(active, best, np.inf).argmin(axis=1)
        tried = active.copy()
        tried[todo, least[todo]] = False
        mine = open_[doc]
        place = np.cumsum(open_) - 1
        share, value = mixture(like[mine], weight[mine], place[doc[mine]], len(todo), tried[todo], np.maximum(best[todo], LEAST_SHARE))
        own = value - penalty[todo] * tried[todo].sum(axis=1)
        better = own >= score[todo]
        moved = todo[better]
        active[moved], best[moved], score[moved] = tried[moved], share[better], own[better]
        open_ = np.zeros(n, bool)
        open_[moved] = active[moved].sum(axis=1) > 1
    return best


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray] | None) -> DataFrame:
    """``doc_id``, ``lang_pred``, ``score`` and ``languages``: the chosen set with its proportions."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # SLOTS numbers per language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, table = shared.value or ([], np.zeros((SLOTS, 0), np.float32))
        for batch in batches:
            for part, raw, offsets in blocks(batch):
                slots, owners, first = gram_slots(raw, offsets)
                share = proportions(slots, owners, first, table) if names else np.zeros((part.num_rows, 0))
                plain = per_text(((raw >= 65) & (raw <= 90)) | ((raw >= 97) & (raw <= 122)), offsets) > 0
                texts = part.column("text")
                ids, scores, sets = [], [], []
                for i in range(part.num_rows):
                    lettered = plain[i] or (first[i + 1] > first[i] and bool(ANY_LETTER.search(texts[i].as_py())))
                    if not names or not lettered or first[i + 1] == first[i]:
                        ids.append("und"), scores.append(0.0), sets.append([])
                        continue
                    k = int(share[i].argmax())
                    ids.append(names[k]), scores.append(float(min(max(share[i, k], 0.0), 1.0)))
                    own = [j for j in np.argsort(-share[i], kind="stable").tolist() if share[i, j] > LEAST_SHARE]
                    sets.append([{"lang": names[j], "share": float(share[i, j])} for j in own])
                sets = pa.array(sets, pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())])))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(ids, pa.string()), pa.array(scores, pa.float64()), sets],
                    ["doc_id", "lang_pred", "score", "languages"],
                )

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, lang_pred string, score double, languages array<struct<lang:string,share:double>>"
    )


def predictions(docs: DataFrame) -> DataFrame:
    """Language of every document, learnt only outside the held-out third."""
    held = F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out")
    return identify(docs, fit(docs)).select("doc_id", held, "lang_pred", "score", "languages")
