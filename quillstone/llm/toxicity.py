"""Toxicity by compression distance.

Two zstandard dictionaries of equal size are made from labelled text: both begin with the same
common words, after which one holds what toxic text favours and the other what ordinary text
favours. A window of a text is compressed with either; its gain is the number of bytes
that the toxic dictionary saves. Each gain has calibrated log odds, and a logistic curve over the
odds of a text's windows, fitted on the labelled sample, gives the score.

Defined results: a null, empty or wordless text has no windows and scores as a text without a
gain; repeated rows score alike; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _grams as G
from ._labels import labelled

#: Words of a window; bytes of each dictionary's shared and own part; level of compression.
WINDOW = 8
SHARED, OWN = 65536, 4096
LEVEL = 9
#: Bytes of the stretches that a class may favour, in how many of its documents' words, and by what ratio.
GRAM, LEAST, RATE = 5, 3, 20
#: Follows each window, so that even a window without a match is compressed.
CARRIER = bytes(64)
#: A window's text is cut into windows of at most so many bytes where its words are very long.
WIDEST = 512
#: Gains beyond these count as these.
LOWEST, HIGHEST = -2, 10
REJECT_AT = 0.7
SAMPLE = {1: 2000, 0: 4000}


@dataclass(frozen=True)
class Model:
    toxic: bytes
    ordinary: bytes
    odds: tuple[float, ...] = (0.0,) * (HIGHEST - LOWEST + 1)
    weights: tuple[float, ...] = (0.0, 0.0, 0.0)


class Gains:
    """Compresses windows with both dictionaries of a model."""

    def __init__(self, model: Model):
        self.coders = []
        for content in (model.ordinary, model.toxic):
            held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(level=LEVEL)
            self.coders.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False))

    def __call__(self, texts: G.Texts) -> tuple[np.ndarray, np.ndarray]:
        """Each window's gain, and the documents' offsets."""
        starts, ends, offs = texts.words()
        raw = lowered(texts.data).tobytes()
        spans, at = windows(starts, ends, offs)
        plain, toxic = self.coders[0].compress, self.coders[1].compress
        gains = np.fromiter((len(plain(w)) - len(toxic(w)) for w in (b" %b %b" % (raw[a:b], CARRIER) for a, b in spans)), np.int64, len(spans))
        return gains, at


def lowered(data: np.ndarray) -> np.ndarray:
    return data + np.where((data >= 65) & (data <= 90), np.uint8(32), np.uint8(0))


def windows(starts: np.ndarray, ends: np.ndarray, offs: np.ndarray, size: int = WINDOW) -> tuple[list[tuple[int, int]], np.ndarray]:
    """(from, to) of each run of `size` words of a document, cut further where it is too wide."""
    counts = np.diff(offs)
    many = -(-counts // size)
    at = np.concatenate([[0], np.cumsum(many)])
    owner = np.repeat(np.arange(len(counts)), many)
    first = offs[owner] + (np.arange(at[-1]) - at[owner]) * size
    last = np.minimum(first + size, offs[owner + 1]) - 1
    a, b = starts[first], ends[last]
    cuts = np.maximum(1, -(-(b - a) // WIDEST))
    if cuts.size and cuts.max() > 1:
        part = np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        a, b, owner = np.repeat(a, cuts) + part * WIDEST, np.repeat(b, cuts), np.repeat(owner, cuts)
        b = np.minimum(b, a + WIDEST)
        at = np.searchsorted(owner, np.arange(len(counts) + 1))
    return list(zip(a.tolist(), b.tolist(), strict=True)), at


def _words(text: bytes) -> set[bytes]:
    return {w.strip(b".,;:!?\"'()[]#*$%&|<>") for w in text.lower().split()} - {b""}


def dictionaries(rows: list[tuple[bytes, int]]) -> Model:
    """The two dictionaries, from (text, label) rows.

    Whole words would bring their ordinary parts along, so a class's own part holds segments:
    the stretches of its words whose every `GRAM` bytes are far commoner in that class.
    """
    seen = (Counter(), Counter())
    for text, label in rows:
        seen[bool(label)].update(_words(text))
    n_toxic = max(1, sum(label for _, label in rows))
    totals = (max(1, len(rows) - n_toxic), n_toxic)
    grams = (Counter(), Counter())
    for label in (0, 1):
        for word, n in seen[label].items():
            for gram in {g for g in _grams(word)}:
                grams[label][gram] += n
    common = sorted(seen[0], key=lambda w: (-seen[0][w], w))
    base = _packed([b" %b " % w for w in common[: SHARED // 2]], SHARED)
    own = []
    for label in (0, 1):
        favours = lambda g, a=grams[label], b=grams[1 - label], m=totals[label], n=totals[1 - label]: a[g] >= LEAST and a[g] * n >= LEAST * m and a[g] * n >= RATE * (b[g] + 0.1) * m
        order = sorted((w for w, n in seen[label].items() if n >= LEAST and any(map(favours, _grams(w)))), key=lambda w: (-seen[label][w], w))
        own.append(_packed(_segments(order, favours), OWN))
    return Model(base + own[1], base + own[0])


def _grams(word: bytes) -> list[bytes]:
    word = b" %b " % word
    return [word[i : i + GRAM] for i in range(len(word) - GRAM + 1)]


def _segments(words: list[bytes], favours: Callable[[bytes], bool]) -> Iterator[bytes]:
    """Maximal stretches of favoured grams, of each word that has one that no earlier word had."""
    had: set[bytes] = set()
    for word in words:
        grams, run = _grams(word), b""
        if all(g in had or not favours(g) for g in grams):
            continue
        for gram in [*grams, b""]:
            if gram and favours(gram):
                run = run + gram[-1:] if run else gram
                had.add(gram)
            elif run:
                yield run
                run = b""


def _packed(parts: Iterable[bytes], size: int) -> bytes:
    """The first parts that fit, the first one last (near parts cost the fewest bits), padded in front."""
    taken, used = [], 0
    for part in parts:
        if used + len(part) > size:
            break
        taken.append(part)
        used += len(part)
    return b"".join(taken[::-1]).rjust(size, b"\0")


def evidence(gains: np.ndarray, at: np.ndarray, odds: np.ndarray) -> np.ndarray:
    """For each text: a constant, the sum of its windows' log odds, and their mean."""
    total = G.span_sums(odds[np.clip(gains, LOWEST, HIGHEST) - LOWEST], at)
    n = np.maximum(1, np.diff(at))
    return np.stack([np.ones(len(n)), np.clip(total, -30, 30) / 10, total / n], 1)


def window_odds(gains: np.ndarray, owners: np.ndarray) -> np.ndarray:
    """The log odds of each gain in a toxic text's windows against an ordinary text's; never falling with the gain."""
    size = HIGHEST - LOWEST + 1
    at = np.clip(gains, LOWEST, HIGHEST) - LOWEST
    toxic, plain = (np.bincount(at[owners == k], minlength=size) + 0.5 for k in (1, 0))
    return np.maximum.accumulate(np.log(toxic / toxic.sum()) - np.log(plain / plain.sum()))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 30) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (y - p) / len(y) - ridge * w
        curve = (x * (p * (1 - p))[:, None]).T @ x / len(y) + ridge * np.eye(len(w))
        w = w + np.linalg.solve(curve, slope)
    return w


def fit(rows: list[tuple[bytes, int]]) -> Model:
    """Odds and curve from the odd rows of the sample under dictionaries of the even ones; then dictionaries of all rows."""
    odd = rows[1::2]
    if len({label for _, label in odd}) < 2:
        return dictionaries(rows)
    model = dictionaries(rows[::2])
    texts = G.texts_of(pa.array([t for t, _ in odd], pa.binary()))
    y = np.array([label for _, label in odd], float)
    gains, at = Gains(model)(texts)
    odds = window_odds(gains, np.repeat(y, np.diff(at)))
    G.trim()
    full = dictionaries(rows)
    G.trim()
    return Model(full.toxic, full.ordinary, tuple(odds.tolist()), tuple(_logistic(evidence(gains, at, odds), y).tolist()))


def score(model: Model, gains: Gains, texts: G.Texts) -> np.ndarray:
    found, at = gains(texts)
    return 1 / (1 + np.exp(-np.clip(evidence(found, at, np.array(model.odds)) @ np.array(model.weights), -30, 30)))


def fit_on(documents: DataFrame, labels: DataFrame) -> Model:
    return fit(labelled(documents, labels, "toxic", SAMPLE))


def score_texts(documents: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and score (0 to 1, higher: more likely toxic) of each whole text."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gains = Gains(model)
        for part, texts in G.batches(frames, text):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score(model, gains, texts))], [key, "score"])

    return documents.select(key, text).mapInArrow(run, f"{key} {documents.schema[key].dataType.simpleString()}, score double")


def drop_toxic(documents: DataFrame, model: Model, at: float = REJECT_AT) -> DataFrame:
    """The documents, with all their columns, whose text scores below `at`.

    Only the texts go to Python and only scores come back; the rows stay on the JVM.
    """

    @F.arrow_udf("double")
    def scores(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        gains = Gains(model)
        for column in columns:
            yield pa.array(np.concatenate([score(model, gains, part) for _, _, part in G.pieces(G.texts_of(column))] or [np.zeros(0)]))
        G.trim()

    return documents.where(scores("text") < at)
