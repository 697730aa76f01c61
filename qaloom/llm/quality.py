"""Quality rules and a hashed n-gram classifier.

Base figures of every text are exact counts from one pass over its bytes. The verdict is
a logistic regression over hashed words and hashed character n-grams (frequencies scaled
to unit length), trained on a bounded sample of labelled rows outside the held-out third
(``SAMPLE`` rows, those with the least hash of their id). Part of the sample is kept from
the fit and calibrates its margin to a probability. Texts are scored in Arrow batches
against fixed thresholds; nothing is shuffled but the sampled ids.

Defined results: a null text has no words and fails the base rules; lines are compared
byte by byte; a document labelled twice takes its lower label; without labels of both
kinds the classifier keeps everything. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from qaloom.llm.batches import LETTER, SPACE, blocks, grams, lowered, mix, per_text, span_hashes, words
from qaloom.llm.registry import held_out

SAMPLE = 6_000
BITS = 17  # of the feature space of each kind
CHAR_GRAMS = (2, 3, 4)  # bytes
LEAST_WORDS = 50
MOST_REPEATED = 50  # percent of the words
KEPT_FROM = 0.5  # calibrated probability of good quality
EPOCHS = 6

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True


def repeats(keys: np.ndarray, text_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each key occurs twice or more in its text, and whether it occurred earlier."""
    code = mix(keys ^ mix(text_of.astype(np.uint64) + np.uint64(0x5851F42D4C957F2D)))
    order = np.argsort(code, kind="stable")
    same = code[order][1:] == code[order][:-1]
    twice, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return twice | later, later


def base_counts(raw: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    n = len(offsets) - 1
    starts, ends, first = words(raw, offsets)
    hashes = span_hashes(raw, starts, ends)
    text_of_word = np.repeat(np.arange(n), np.diff(first))
    covered = np.zeros(len(starts), bool)
    if len(starts) >= 3:
        windows = grams(hashes, 3)
        inside = np.flatnonzero(text_of_word[:-2] == text_of_word[2:])
        twice, _ = repeats(windows[inside], text_of_word[inside])
        for j in range(3):
            covered[inside[twice] + j] = True
    newline = np.flatnonzero(raw == 0x0A)
    begin = np.unique(np.concatenate([offsets[:-1], newline + 1]))
    begin = begin[begin < len(raw)]
    end = np.searchsorted(newline, begin)
    end = np.append(newline, len(raw))[end] if len(begin) else begin
    text_of_line = np.searchsorted(offsets, begin, side="right") - 1
    end = np.minimum(end, offsets[text_of_line + 1])
    worded = np.searchsorted(starts, end) > np.searchsorted(starts, begin)
    begin, end, text_of_line = begin[worded], end[worded], text_of_line[worded]
    _, later = repeats(span_hashes(raw, begin, end), text_of_line)
    return {
        "n_words": np.diff(first),
        "word_chars": per_text(~SPACE[raw] & ((raw & 0xC0) != 0x80), offsets),
        "n_symbols": per_text(SYMBOL[raw], offsets),
        "n_dup_lines": np.bincount(text_of_line[later], minlength=n),
        "n_repeat_words": np.bincount(text_of_word[covered], minlength=n),
    }


def feature_places(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in the feature space and the text of each: words first, then character n-grams."""
    n = len(offsets) - 1
    mask = np.uint64((1 << BITS) - 1)
    small = lowered(raw)
    starts, ends, first = words(small, offsets, LETTER)
    places = [(span_hashes(small, starts, ends) & mask).astype(np.int64)]
    owners = [np.repeat(np.arange(n), np.diff(first))]
    text_of = np.repeat(np.arange(n), np.diff(offsets))
    for k, size in enumerate(CHAR_GRAMS, 1):
        if len(raw) < size:
            continue
        count = len(raw) - size + 1
        h = np.zeros(count, np.uint32)
        for j in range(size):
            h = h * np.uint32(0x01000193) + raw[j : j + count]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(13)
        inside = text_of[:count] == text_of[size - 1 :]
        places.append((h[inside] & np.uint32(mask)).astype(np.int64) + (k << BITS))
        owners.append(text_of[:count][inside])
    return np.concatenate(places), np.concatenate(owners)


WIDTH = (1 + len(CHAR_GRAMS)) << BITS


def margins(raw: np.ndarray, offsets: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Sum of weight x frequency over the features of each text, per kind scaled by the number of features."""
    n = len(offsets) - 1
    places, owners = feature_places(raw, offsets)
    kind = places >> BITS
    total = np.bincount(owners * (1 + len(CHAR_GRAMS)) + kind, weights[places], minlength=n * (1 + len(CHAR_GRAMS)))
    count = np.bincount(owners * (1 + len(CHAR_GRAMS)) + kind, minlength=n * (1 + len(CHAR_GRAMS)))
    return (total / np.maximum(count, 1)).reshape(n, -1).sum(axis=1)


def sample_features(docs: DataFrame, labels: DataFrame, size: int) -> DataFrame:
    """``good``, ``places``, ``shares`` (frequency of each feature) of at most ``size`` labelled rows."""
    known = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
        .groupBy("doc_id")
        .agg((F.min("quality") > 0).alias("good"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(size)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, offsets in blocks(batch):
                places, owners = feature_places(raw, offsets)
                found, shares = [], []
                order = np.argsort(owners, kind="stable")
                edges = np.searchsorted(owners[order], np.arange(len(offsets)))
                for a, b in zip(edges, edges[1:]):
                    own, counts = np.unique(places[order[a:b]], return_counts=True)
                    kinds = np.bincount(places[order[a:b]] >> BITS, minlength=1 + len(CHAR_GRAMS))
                    found.append(own.astype(np.int32))
                    shares.append((counts / kinds[own >> BITS]).astype(np.float32))
                yield pa.RecordBatch.from_arrays(
                    [part.column("good"), pa.array(found, pa.list_(pa.int32())), pa.array(shares, pa.list_(pa.float32()))],
                    ["good", "places", "shares"],
                )

    sampled = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")  # at most ``size`` ids
    return sampled.orderBy(F.xxhash64("doc_id"), "doc_id").select("text", "good").mapInArrow(
        run, "good boolean, places array<int>, shares array<float>"
    )


def fit(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> np.ndarray | None:
    """Weights of all features, then slope and intercept of the calibration; None without two classes."""
    table = sample_features(docs, labels, size).toArrow()  # bounded by the sample
    good = np.array(table["good"].to_pylist(), bool)
    if good.all() or not good.any():
        return None
    lists = table["places"].combine_chunks()
    bounds = np.asarray(lists.offsets, np.int64)
    places = lists.values.to_numpy()
    shares = table["shares"].combine_chunks().values.to_numpy()
    fit_rows = np.flatnonzero(np.arange(len(good)) % 4 != 0)
    # AdaGrad over single rows: a row touches only its own features.
    weights, square, bias = np.zeros(WIDTH), np.full(WIDTH, 1e-6), 0.0
    draw = np.random.default_rng(7)
    share_of = {True: 0.5 / max(good[fit_rows].mean(), 1e-9), False: 0.5 / max(1 - good[fit_rows].mean(), 1e-9)}
    for _ in range(EPOCHS):
        for i in draw.permutation(fit_rows):
            a, b = bounds[i], bounds[i + 1]
            own, x = places[a:b], shares[a:b]
            p = 1 / (1 + np.exp(-np.clip(weights[own] @ x + bias, -30, 30)))
            slope = (p - good[i]) * share_of[bool(good[i])]
            g = slope * x
            square[own] += g * g
            weights[own] -= 0.5 * g / np.sqrt(square[own])
            bias -= 0.02 * slope
    margin = np.array([weights[places[bounds[i] : bounds[i + 1]]] @ shares[bounds[i] : bounds[i + 1]] for i in range(len(good))]) + bias
    held = np.flatnonzero(np.arange(len(good)) % 4 == 0)
    slope, intercept = calibrate(margin[held], good[held])
    return np.append(weights, [slope, intercept + slope * bias]).astype(np.float64)


def calibrate(margin: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of the logistic curve through the held rows, smoothed targets, by Newton steps."""
    yes, no = good.sum(), (~good).sum()
    target = np.where(good, (yes + 1) / (yes + 2), 1 / (no + 2))
    theta = np.array([1.0, 0.0])
    x = np.stack([margin, np.ones_like(margin)], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, x.T @ (p - target) + 1e-3 * (theta - [1, 0]))
        theta = theta - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return float(max(theta[0], 1e-3)), float(theta[1])


RESULT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, quality double"


def measured(docs: DataFrame, model: np.ndarray | None) -> DataFrame:
    """``doc_id``, the base counts and ``quality``, the calibrated probability of a good text."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    # The feature space has a fixed width, whatever the data.
    shared = docs.sparkSession.sparkContext.broadcast(None if model is None else model.astype(np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for part, raw, offsets in blocks(batch):
                counts = base_counts(raw, offsets)
                p = np.ones(part.num_rows)
                if own is not None:
                    z = margins(raw, offsets, own[:-2].astype(np.float64)) * own[-2] + own[-1]
                    p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                columns = [pa.array(c.astype(np.int64)) for c in counts.values()]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns, pa.array(p)], ["doc_id", *counts, "quality"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {RESULT}")


def verdicts(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> DataFrame:
    """Counts, base rules and verdict of every document."""
    n, repeated = F.col("n_words"), F.col("n_repeat_words")
    failed = (n < LEAST_WORDS) | (100 * repeated > MOST_REPEATED * n)
    rows = measured(docs, fit(docs, labels, size)).withColumn("base_failed", failed)
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= KEPT_FROM))
