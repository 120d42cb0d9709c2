"""Language identification: words first, then ever shorter character n-grams.

A word of the model scores by its log frequency in each language. Any other word is backed off:
its longest character n-grams (over the bytes of the word between two blanks, in lower case)
that the model knows score instead, and if it knows none of that length, the next shorter ones.
A text's language is the one with the largest sum over its words; the score is the share of its
probability at the mean word.

Learned from a bounded, documented sample of labelled documents. Defined results: a text that is
null or without a letter is `und` with score 0; ties go to the first language by code point;
without any labelled document every text is `und`; repeated rows score alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _grams as G
from ._labels import LONGEST, held_out

ORDERS = (5, 4, 3, 2, 1)
#: Labelled documents that are learned from at most (but one of each language); words and n-grams of each order kept at most.
SAMPLE, KEPT = 2000, 60000
FLOOR = 0.5


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    keys: tuple[np.ndarray, ...]  # of words, then of each order: sorted fingerprints
    logs: tuple[np.ndarray, ...]  # the log frequency of each in each language


#: Capitals that UTF-8 writes in two bytes, and as many as their small letters: the first byte, the second from and to, and what is added to either.
CAPITALS = (
    (0xC3, 0x80, 0x9E, 0, 0x20),  # Latin-1
    (0xCE, 0x91, 0x9F, 0, 0x20), (0xCE, 0xA0, 0xA9, 1, -0x20),  # Greek
    (0xD0, 0x80, 0x8F, 1, 0x10), (0xD0, 0x90, 0x9F, 0, 0x20), (0xD0, 0xA0, 0xAF, 1, -0x20),  # Cyrillic
)


def _lower(data: np.ndarray) -> np.ndarray:
    """Lower case of A-Z and of `CAPITALS`."""
    out = data + np.where((data >= 65) & (data <= 90), np.uint8(32), np.uint8(0))
    for lead, first, last, up, over in CAPITALS:
        at = np.flatnonzero((data[:-1] == lead) & (data[1:] >= first) & (data[1:] <= last))
        out[at] += np.uint8(up)
        out[at + 1] += np.uint8(over % 256)
    return out


_MARKS = np.zeros(256, bool)
_MARKS[[c for c in range(0x21, 0x7F) if not chr(c).isalpha()]] = True


def spaced(texts: G.Texts) -> G.Texts:
    """Lower case, with ASCII digits and punctuation made blanks."""
    low = _lower(texts.data)
    low[_MARKS[low]] = 32
    return G.Texts(low, texts.offs)


def grams(low: G.Texts, starts: np.ndarray, ends: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of the n-grams of some words, each between two blanks, and the words' offsets."""
    sizes = np.maximum(0, ends - starts + 2 - n + 1)
    at = np.concatenate([[0], np.cumsum(sizes)])
    owner = np.repeat(np.arange(len(starts)), sizes)
    first = np.arange(at[-1]) - at[owner] + starts[owner] - 1
    padded = np.concatenate([[np.uint8(32)], low.data, [np.uint8(32)]])
    h = np.full(len(first), n, G.U)
    for i in range(n):
        place = first + i
        byte = padded[np.minimum(place + 1, len(padded) - 1)]
        if i == 0:
            byte = np.where(place < starts[owner], np.uint8(32), byte)
        if i == n - 1:
            byte = np.where(place >= ends[owner], np.uint8(32), byte)
        h = (h << G.U(8)) | byte.astype(G.U)
    return G.mix(h), at


def fit(rows: list[tuple[bytes, str]]) -> Model:
    """From (text, language) rows."""
    kept = sorted({language for _, language in rows})
    place = {x: i for i, x in enumerate(kept)}
    if not kept:
        return Model((), (), ())
    gathered: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = [[] for _ in range(1 + len(ORDERS))]
    language = np.array([place[x] for _, x in rows])
    for i, j, part in G.pieces(G.texts_of(pa.array([t for t, _ in rows], pa.binary())), 1 << 18):
        low = spaced(part)
        starts, ends, offs = low.words()
        owner = language[i:j][np.repeat(np.arange(part.n), np.diff(offs))]
        for k, n in enumerate((0, *ORDERS)):
            h, at = (low.hashes(starts, ends), np.arange(len(starts) + 1)) if not n else grams(low, starts, ends, n)
            who = np.repeat(owner, np.diff(at))
            order = np.lexsort((who, h))
            h, who = h[order], who[order]
            new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (who[1:] != who[:-1])])) if len(h) else np.zeros(0, np.int64)
            gathered[k].append((h[new], who[new], np.diff(np.append(new, len(h)))))
    keys, logs = [], []
    for k, found in enumerate(gathered):
        h, who, n = (np.concatenate(x) for x in zip(*found, strict=True))
        every, where = np.unique(h, return_inverse=True)
        table = np.zeros((len(every), len(kept)))
        np.add.at(table, (where, who), n)
        total = table.sum(1)
        rate = (table / np.maximum(1, table.sum(0))).max(1)  # a language with few documents keeps its words too
        best = np.sort(np.argsort(-rate, kind="stable")[:KEPT])
        best = best[total[best] >= (2 if k < 3 else 1)]
        mass = table.sum(0) + FLOOR * len(every)
        keys.append(every[best])
        logs.append(np.log((table[best] + FLOOR) / mass).astype(np.float32))
    return Model(tuple(kept), tuple(keys), tuple(logs))


def _known(keys: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    place = np.minimum(np.searchsorted(keys, h), max(0, len(keys) - 1))
    return place, keys[place] == h if len(keys) else np.zeros(len(h), bool)


def _span_rows(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.stack([G.span_sums(values[:, i].astype(np.float64), at) for i in range(values.shape[1])], 1)


def sums(model: Model, texts: G.Texts) -> tuple[np.ndarray, np.ndarray]:
    """For each text the sums of its words' log frequencies, and its number of words that count."""
    low = spaced(texts)
    starts, ends, offs = low.words()
    place, known = _known(model.keys[0], low.hashes(starts, ends))
    scores = np.zeros((len(starts), len(model.languages)), np.float32)
    scores[known] = model.logs[0][place[known]]
    counted = known
    left = np.flatnonzero(~known)
    for k, n in enumerate(ORDERS, 1):
        if not len(left):
            break
        h, at = grams(low, starts[left], ends[left], n)
        place, known = _known(model.keys[k], h)
        hits = G.span_sums(known.astype(np.int64), at)
        kept = np.flatnonzero(known)
        means = _span_rows(model.logs[k][place[kept]], np.searchsorted(kept, at)) / np.maximum(1, hits)[:, None]
        scores[left[hits > 0]] = means[hits > 0]
        counted[left[hits > 0]] = True
        left = left[hits == 0]
    return _span_rows(scores, offs), G.span_sums(counted.astype(np.int64), offs)


def _has_letter(column: pa.Array) -> np.ndarray:
    """Whether each text has a letter of any script."""
    out = np.asarray(pc.fill_null(pc.match_substring_regex(column, r"\pL"), False).to_numpy(zero_copy_only=False), bool)
    return out


def predict(model: Model, texts: G.Texts, letters: np.ndarray) -> tuple[list[str], np.ndarray]:
    if not model.languages:
        return ["und"] * texts.n, np.zeros(texts.n)
    total, n = sums(model, texts)
    mean = total / np.maximum(1, n)[:, None]
    best = mean.argmax(1)
    share = 1 / np.exp(mean - mean.max(1, keepdims=True)).sum(1)
    return [model.languages[b] if x else "und" for b, x in zip(best, letters, strict=True)], np.where(letters, share, 0.0)


def bounds(sizes: dict[str, int], most: int = SAMPLE) -> dict[str, int]:
    """How many documents of each language are learned from: equal shares, of which small languages leave what they can't fill."""
    out, left = {}, most
    for place, language in enumerate(sorted(sizes, key=lambda x: (sizes[x], x))):
        out[language] = min(sizes[language], max(1, left // (len(sizes) - place)))
        left -= out[language]
    return out


def fit_on(documents: DataFrame) -> Model:
    """From a sample, by hash, of each language's documents that aren't held out."""
    rows = documents.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out() & (F.octet_length("text") <= LONGEST))
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    share = [(language, int((1 << 32) * most / sizes[language])) for language, most in bounds(sizes).items()]
    if not share:
        return fit([])
    taken = documents.sparkSession.createDataFrame(share, "lang string, _share long")  # a row a language
    chosen = rows.join(F.broadcast(taken), "lang").where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 32)) < F.col("_share"))
    return fit(sorted((bytes(r[0]), r[1]) for r in chosen.select(F.col("text").cast("binary"), "lang").collect()))


def identify(documents: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, lang_pred and score of each whole text."""
    held = documents.sparkSession.sparkContext.broadcast(model)  # KEPT keys, a number for each language

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in G.batches(frames, text):
            found, score = predict(held.value, texts, _has_letter(part.column(1)))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.string()), pa.array(score)], [key, "lang_pred", "score"])

    return documents.select(key, text).mapInArrow(run, f"{key} {documents.schema[key].dataType.simpleString()}, lang_pred string, score double")
