"""Supervised subword embeddings: averaged vectors of hashed word and character n-grams.

A document's features are its words, pairs of words and character n-grams (over the UTF-8 bytes
in lower case, white space included), hashed into buckets, plus one bucket for runs of three
words that the document has had before. The vectors of its features are averaged and a softmax
layer gives the label; both are learned by stochastic gradient descent in numpy on a bounded,
documented sample. As the layers are linear up to the softmax, scoring needs one number a bucket.

Defined results: a null, empty or featureless text has the average vector 0, so its score is the
softmax of the bias; repeated rows score alike; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import _grams as G
from ._labels import labelled

BUCKETS = 1 << 18
DIM = 8
CHARS = (3, 4)
EPOCHS, RATE, BATCH = 4, 2.0, 64
#: Small samples are gone through more often, until so many batches are done.
LEAST_STEPS = 180
SAMPLE = {0: 1000, 1: 2000}
#: Buckets 0 to 2 aren't hashed into: words repeated at once, and repeated runs of three words.
TWIN, AGAIN, OWN = 0, 1, 3


@dataclass(frozen=True)
class Model:
    table: np.ndarray  # for each bucket the difference of the two labels' logits
    bias: float


def _lower(data: np.ndarray) -> np.ndarray:
    return data + np.where((data >= 65) & (data <= 90), np.uint8(32), np.uint8(0))


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h % G.U(BUCKETS - OWN)).astype(np.int32) + np.int32(OWN)


def feature_groups(texts: G.Texts) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(buckets, the documents' offsets) of each kind of feature."""
    low = G.Texts(_lower(texts.data), texts.offs)
    starts, ends, offs = low.words()
    words = low.hashes(starts, ends)
    yield _bucket(words), offs
    for k in (2, 3):
        counts = np.maximum(0, np.diff(offs) - k + 1)
        at = np.concatenate([[0], np.cumsum(counts)])
        owner = np.repeat(np.arange(len(counts)), counts)
        first = np.arange(at[-1]) - at[owner] + offs[owner]
        h = np.zeros(len(first), G.U)
        for i in range(k):
            h = h * G.U(0x2545F4914F6CDD1D) + words[first + i]
        if k == 2:
            yield np.where(words[first] == words[first + 1], np.int32(TWIN), _bucket(G.mix(h))), at
        else:
            again = np.zeros(len(h), bool)
            keyed = h + owner.astype(G.U) * G.U(0x9E3779B97F4A7C15)
            order = np.argsort(keyed, kind="stable")
            again[order[1:][keyed[order][1:] == keyed[order][:-1]]] = True
            kept = np.flatnonzero(again)
            yield np.full(len(kept), AGAIN, np.int32), np.searchsorted(kept, at)
    for n in CHARS:
        size = len(low.data) - n + 1
        if size <= 0:
            continue
        h = np.full(size, n, np.uint32)
        for i in range(n):
            h = (h ^ low.data[i : i + size]) * np.uint32(0x01000193)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        h ^= h >> np.uint32(12)
        inside = np.ones(size, bool)
        for i in range(1, n):
            over = low.offs[1:-1] - i
            inside[over[(over >= 0) & (over < size)]] = False
        place = np.flatnonzero(inside)
        yield (h[place] % np.uint32(BUCKETS - OWN)).astype(np.int32) + np.int32(OWN), np.searchsorted(place, low.offs)


def totals(texts: G.Texts, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each document the sum of its features' numbers, and how many it has."""
    sums, counts = np.zeros(texts.n), np.zeros(texts.n, np.int64)
    for buckets, at in feature_groups(texts):
        sums += G.span_sums(table[buckets], at)
        counts += np.diff(at)
    return sums, counts


def score(model: Model, texts: G.Texts) -> np.ndarray:
    """The probability of label 1."""
    sums, counts = totals(texts, model.table)
    return 1 / (1 + np.exp(-np.clip(model.bias + sums / np.maximum(1, counts), -30, 30)))


def fit(rows: list[tuple[bytes, int]], seed: int = 7) -> Model:
    """Vectors and softmax from (text, label) rows, by mini-batches in a fixed shuffled order."""
    if not rows:
        return Model(np.zeros(BUCKETS, np.float32), 0.0)
    docs: list[tuple[np.ndarray, np.ndarray]] = []
    for _, _, part in G.pieces(G.texts_of(pa.array([t for t, _ in rows], pa.binary()))):
        groups = list(feature_groups(part))
        for i in range(part.n):
            found, n = np.unique(np.concatenate([b[at[i] : at[i + 1]] for b, at in groups] or [np.zeros(0, np.int32)]), return_counts=True)
            docs.append((found, (n / max(1, n.sum())).astype(np.float32)))
    y = np.array([label for _, label in rows], np.int64)
    random = np.random.default_rng(seed)
    used = np.unique(np.concatenate([found for found, _ in docs]))
    vectors = np.zeros((BUCKETS, DIM), np.float32)
    vectors[used] = random.uniform(-1 / DIM, 1 / DIM, (len(used), DIM))
    layer, bias = random.normal(0, 0.3, (DIM, 2)).astype(np.float32), np.zeros(2, np.float32)
    epochs = max(EPOCHS, -(-LEAST_STEPS * BATCH // len(docs)))
    steps, step = epochs * -(-len(docs) // BATCH), 0
    for _ in range(epochs):
        order = random.permutation(len(docs))
        for i in range(0, len(order), BATCH):
            batch, rate = order[i : i + BATCH], RATE * (1 - step / steps)
            step += 1
            ids = np.concatenate([docs[j][0] for j in batch])
            shares = np.concatenate([docs[j][1] for j in batch])
            owner = np.repeat(np.arange(len(batch)), [len(docs[j][0]) for j in batch])
            at = np.searchsorted(owner, np.arange(len(batch) + 1))
            hidden = np.stack([G.span_sums(vectors[ids, d] * shares, at) for d in range(DIM)], 1).astype(np.float32)
            logits = hidden @ layer + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            wrong = p
            wrong[np.arange(len(batch)), y[batch]] -= 1
            back = wrong @ layer.T
            layer -= rate / len(batch) * (hidden.T @ wrong)
            bias -= rate / len(batch) * wrong.sum(0)
            # a feature's share is small: each document's step is scaled up to the size that a single feature would make
            places, where = np.unique(ids, return_inverse=True)
            for d in range(DIM):
                vectors[places, d] -= (rate * SCALE / len(batch)) * np.bincount(where, weights=shares * back[owner, d], minlength=len(places)).astype(np.float32)
    return Model((vectors @ (layer[:, 1] - layer[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


#: Vectors learn faster than the layer by this factor, as a text's features share its gradient.
SCALE = 200.0


def fit_on(documents: DataFrame, labels: DataFrame) -> Model:
    return fit(labelled(documents, labels, "quality", SAMPLE))


def score_texts(documents: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and score (0 to 1, higher: more likely of quality) of each whole text."""
    held = documents.sparkSession.sparkContext.broadcast(model)  # a fixed number of buckets

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in G.batches(frames, text):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score(held.value, texts))], [key, "score"])

    return documents.select(key, text).mapInArrow(run, f"{key} {documents.schema[key].dataType.simpleString()}, score double")
