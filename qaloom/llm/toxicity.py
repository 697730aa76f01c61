"""Toxicity by multiple-instance learning.

Only documents are labelled, yet sentences offend. A sentence's probability is logistic in
its word and word-beginning features; a document is toxic unless all its sentences are
clean: ``1 - prod(1 - p_sentence)``, a noisy-or. The fit lowers the document loss through
that product, so blame settles on the sentences that explain it, and scoring then points
at them.

The fit reads a bounded sample of labelled documents (``SAMPLE`` rows, those with the
least hash of their id). Features are 64-bit hashes; those that occur in enough toxic
documents and more often there than elsewhere enter the model, the strongest
``FEATURES`` at most. Scoring is one pass over the texts without any shuffle.

Defined results: a null or empty text has no sentence and scores 0; a document labelled
more than once counts as toxic if any of its labels says so; labels of unknown documents
and null labels are left out. With no toxic label every score is 0. An empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from qaloom.llm.batches import LETTER, blocks, lowered, span_hashes, words
from qaloom.llm.registry import free_name, held_out

SAMPLE = 20_000
FEATURES = 50_000
LEAST_DOCS = 3
LEAST_RATIO = 3.0
BEGINNINGS = (3, 4, 5, 6)  # bytes of word beginnings
STEPS = 400
THRESHOLD = 0.7
LOCATED = 0.5  # a sentence from this probability on is offending

ENDS = np.zeros(256, bool)
ENDS[[0x0A, 0x21, 0x2E, 0x3F]] = True


def features(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Feature hashes (words x kinds), the sentence and start of each word, and the n + 1 word offsets."""
    raw = lowered(raw)
    starts, ends, first = words(raw, offsets, LETTER)
    if not len(starts):
        return np.zeros((0, 1 + len(BEGINNINGS)), np.uint64), starts, starts, first
    kinds = [span_hashes(raw, starts, ends)]
    for k, size in enumerate(BEGINNINGS):
        kinds.append(span_hashes(raw, starts, np.minimum(ends, starts + size)) ^ np.uint64(0x51ED270B * (k + 1)))
    ended = np.cumsum(ENDS[raw])
    sentence = ended[starts]
    text_of = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    new = np.concatenate([[True], (sentence[1:] != sentence[:-1]) | (text_of[1:] != text_of[:-1])])
    return np.stack(kinds, axis=1), np.cumsum(new) - 1, starts, first


def sample_of(docs: DataFrame, labels: DataFrame, size: int) -> DataFrame:
    """``doc_id``, ``text``, ``toxic`` of at most ``size`` labelled documents outside the held-out third."""
    known = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
        .groupBy("doc_id")
        .agg((F.max("toxic") > 0).alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(size)
    )
    # At most ``size`` ids: bounded by the parameter, so they go to every executor.
    return docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")


def feature_counts(sample: DataFrame) -> DataFrame:
    """``feature``, ``toxic``, ``clean``: documents of each kind that have the feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, offsets in blocks(batch):
                hashes, _, _, first = features(raw, offsets)
                toxic = part.column("toxic").to_numpy(zero_copy_only=False).astype(bool)
                seen = [np.unique(hashes[a:b]) for a, b in zip(first, first[1:])]
                counts = np.array([len(s) for s in seen], np.int64)
                found, place = np.unique(np.concatenate(seen), return_inverse=True)
                own = np.repeat(toxic, counts)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(found.view(np.int64)),
                        pa.array(np.bincount(place[own], minlength=len(found))),
                        pa.array(np.bincount(place[~own], minlength=len(found))),
                    ],
                    ["feature", "toxic", "clean"],
                )

    counts = sample.select("text", "toxic").mapInArrow(run, "feature long, toxic long, clean long")
    return counts.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


@dataclass
class Model:
    features: np.ndarray  # sorted hashes
    weights: np.ndarray
    bias: float

    def __post_init__(self):
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[(self.features & np.uint64((1 << 22) - 1)).astype(np.int64)] = True

    def word_weights(self, hashes: np.ndarray) -> np.ndarray:
        """Sum of the weights of each word's features."""
        out = np.zeros(len(hashes))
        for k in range(hashes.shape[1]):
            own = hashes[:, k]
            some = np.flatnonzero(self.maybe[(own & np.uint64((1 << 22) - 1)).astype(np.int64)])
            place = np.minimum(np.searchsorted(self.features, own[some]), len(self.features) - 1)
            hit = self.features[place] == own[some]
            out[some[hit]] += self.weights[place[hit]]
        return out

    def sentence_scores(self, hashes: np.ndarray, sentence: np.ndarray) -> np.ndarray:
        z = np.bincount(sentence, self.word_weights(hashes), minlength=int(sentence[-1]) + 1 if len(sentence) else 0)
        return 1 / (1 + np.exp(-np.clip(z + self.bias, -30, 30)))


def instances(sample: DataFrame, chosen: np.ndarray) -> DataFrame:
    """Per document: its label, how many sentences have no chosen feature, and the features of the others."""
    model = Model(chosen, np.zeros(len(chosen)), 0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, offsets in blocks(batch):
                hashes, sentence, _, first = features(raw, offsets)
                place = np.minimum(np.searchsorted(model.features, hashes), len(model.features) - 1)
                word, kind = np.nonzero(model.features[place] == hashes)
                lists, bare = [], []
                edges = np.searchsorted(word, first)
                for i in range(len(offsets) - 1):
                    own = word[edges[i] : edges[i + 1]]
                    pairs = np.unique(np.stack([sentence[own], place[own, kind[edges[i] : edges[i + 1]]]], axis=1), axis=0)
                    lists.append((pairs - [sentence[own[0]], 0]).ravel().tolist() if len(own) else [])
                    total = sentence[first[i + 1] - 1] - sentence[first[i]] + 1 if first[i + 1] > first[i] else 0
                    bare.append(int(total - len(np.unique(pairs[:, 0]))))
                yield pa.RecordBatch.from_arrays(
                    [part.column("toxic"), pa.array(bare, pa.int64()), pa.array(lists, pa.list_(pa.int64()))],
                    ["toxic", "bare", "pairs"],
                )

    return sample.select("text", "toxic").mapInArrow(run, "toxic boolean, bare long, pairs array<long>")


def fit_noisy_or(rows: list, size: int, steps: int = STEPS, rate: float = 0.15, decay: float = 2e-4) -> tuple[np.ndarray, float]:
    """Weights and bias that lower the document loss of the noisy-or, by Adam over all rows."""
    doc, instance, feature = [], [], []
    count = 0
    for i, row in enumerate(rows):
        pairs = np.array(row.pairs, np.int64).reshape(-1, 2)
        if len(pairs):
            _, local = np.unique(pairs[:, 0], return_inverse=True)
            instance.append(local + count)
            feature.append(pairs[:, 1])
            doc += [i] * (int(local.max()) + 1)
            count += int(local.max()) + 1
    doc = np.array(doc, np.int64)
    instance = np.concatenate(instance) if instance else np.zeros(0, np.int64)
    feature = np.concatenate(feature) if feature else np.zeros(0, np.int64)
    bare = np.array([r.bare for r in rows], float)
    toxic = np.array([bool(r.toxic) for r in rows])
    weights, bias = np.zeros(size), -8.0
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, steps + 1):
        z = np.bincount(instance, weights[feature], minlength=count) + bias
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        p0 = 1 / (1 + np.exp(-bias))
        clean = np.bincount(doc, np.log1p(-p * (1 - 1e-9)), minlength=len(rows)) + bare * np.log1p(-p0)
        odds = np.where(toxic, -np.exp(clean) / np.maximum(-np.expm1(clean), 1e-9), 1.0) / len(rows)
        by_instance = odds[doc] * p
        slope = np.append(
            np.bincount(feature, by_instance[instance], minlength=size) + decay * weights / len(rows),
            by_instance.sum() + float(odds @ bare) * p0,
        )
        m += 0.1 * (slope - m)
        v += 0.001 * (slope**2 - v)
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        weights -= move[:-1]
        bias = min(bias - move[-1], -4.0)
    return weights, float(bias)


def fit(docs: DataFrame, labels: DataFrame, sample_size: int = SAMPLE, most: int = FEATURES) -> Model | None:
    """The model, or None where the sample has no toxic or no usable document."""
    sample = sample_of(docs, labels, sample_size)
    ratio = (F.col("toxic") + 0.5) / (F.col("clean") + 0.5)
    counts = feature_counts(sample)
    sizes = labels.where(~held_out("doc_id")).agg(F.avg((F.col("toxic") > 0).cast("double"))).first()[0] or 0.0
    if not 0 < sizes < 1:
        return None
    chosen = (
        counts.where((F.col("toxic") >= LEAST_DOCS) & (ratio >= LEAST_RATIO * sizes / (1 - sizes)))
        .orderBy(F.desc(F.col("toxic") * F.log(ratio * (1 - sizes) / sizes)), "feature")
        .limit(most)
        .select("feature")
        .toArrow()
    )
    if not chosen.num_rows:
        return None
    hashes = np.sort(chosen["feature"].to_numpy().view(np.uint64))
    rows = instances(sample, hashes).collect()  # bounded by the sample
    return Model(hashes, *fit_noisy_or(rows, len(hashes)))


def score(docs: DataFrame, model: Model | None, out: str = "toxicity") -> DataFrame:
    """``docs`` with struct ``out``: ``score``, and ``sentences`` (byte start, byte end, score) that offend."""
    from pyspark.sql.types import StructField, StructType, _parse_datatype_string

    kind = "struct<score:double,sentences:array<struct<start:int,end:int,score:double>>>"
    arrow_kind = pa.struct(
        [("score", pa.float64()), ("sentences", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])))]
    )
    if any(c.lower() == out.lower() for c in docs.columns):
        raise ValueError(f"column {out} exists; name another with out=")
    parts = (model.features, model.weights, model.bias) if model else None
    shared = docs.sparkSession.sparkContext.broadcast(parts)  # at most FEATURES numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value) if shared.value else None
        for batch in batches:
            for part, raw, offsets in blocks(batch):
                n = part.num_rows
                scores, found = np.zeros(n), [[] for _ in range(n)]
                if own is not None:
                    hashes, sentence, starts, first = features(raw, offsets)
                    p = own.sentence_scores(hashes, sentence)
                    if len(p):
                        head = np.searchsorted(sentence, np.arange(len(p)))
                        text_of = np.searchsorted(first, head, side="right") - 1
                        scores = -np.expm1(np.bincount(text_of, np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=n))
                        ends = np.flatnonzero(ENDS[raw])
                        for s in np.flatnonzero(p >= LOCATED).tolist():
                            i, begin = int(text_of[s]), int(starts[head[s]])
                            stop = np.searchsorted(ends, begin)
                            end = int(min(ends[stop] + 1 if stop < len(ends) else len(raw), offsets[i + 1]))
                            found[i].append({"start": begin - int(offsets[i]), "end": end - int(offsets[i]), "score": float(p[s])})
                rows = [{"score": float(s), "sentences": f} for s, f in zip(np.clip(scores, 0, 1), found)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(rows, arrow_kind)], [*part.schema.names, out])

    schema = StructType([*docs.schema.fields, StructField(out, _parse_datatype_string(kind))])
    return docs.mapInArrow(run, schema)


def predictions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score and decision of every document; labels come only from outside the held-out third."""
    model = fit(docs, labels)
    scored = score(docs.select("doc_id", "text"), model)
    p = F.col("toxicity.score")
    return scored.select(
        "doc_id",
        F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"),
        p.alias("score"),
        F.when(p >= THRESHOLD, 1).otherwise(0).alias("predicted"),
        F.col("toxicity.sentences").alias("offending"),
    )


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents scored below the threshold, with the columns they came with."""
    out = free_name(docs, "toxicity")
    scored = score(docs, fit(docs, labels), out)
    return scored.where(scored[out]["score"] < threshold).select(*[scored[c] for c in docs.columns])
