"""Quality rules as a ledger: every rule is evaluated once, policies come later.

`ledger` stores for each document its measurements and one bit per failed rule. A `Policy`
names the rules that reject; `apply_policy` and `ablation` need only the bits, so a new policy
costs no second look at the texts.

Words are `[^\\x20\\x09-\\x0D]+` of the whole text. Defined results: a null or empty text has
no words, fails `few_words` and has zero measurements; ties and repeated rows are judged alike;
further columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _grams as G

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
UPPER = np.zeros(256, bool)
UPPER[ord("A") : ord("Z") + 1] = True
WINDOW = 5

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")
#: Rule: SQL over the measurements that is true where the rule fails. The bit is the place in this list; only append.
RULES = {
    "few_words": "n_words < 10",
    "repeated_windows": "100 * n_repeat_words > 20 * n_words",
    "symbols": "10 * n_symbols > 5 * n_words",
    "repeated_lines": "n_lines >= 4 AND 10 * n_dup_lines > 3 * n_lines",
    "shouting": "10 * n_upper > 5 * word_chars",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 20 * n_words",
}
BIT = {name: 1 << i for i, name in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    version: str
    rejects: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BIT[name] for name in self.rejects)


BASE = Policy("base-1", ("few_words", "repeated_windows"))
POLICIES = {p.version: p for p in (BASE, Policy("strict-1", tuple(RULES)))}


def measure(texts: G.Texts) -> dict[str, np.ndarray]:
    """`MEASURES` of each document."""
    starts, ends, offs = texts.words()
    n_words = np.diff(offs)
    solid = ~G.SPACE[texts.data]
    out = {"n_words": n_words, "word_chars": texts.sums(solid & (texts.data & 0xC0 != 0x80)), "n_symbols": texts.sums(SYMBOLS[texts.data]), "n_upper": texts.sums(UPPER[texts.data])}
    out["n_lines"], out["n_dup_lines"] = _lines(texts, starts)
    grams, at = G.shingles(texts.hashes(starts, ends), offs, WINDOW)
    owner = np.repeat(np.arange(texts.n), np.diff(at))
    keyed = G.mix(grams + owner.astype(G.U) * G.U(0x9E3779B97F4A7C15))
    full = n_words[owner] >= WINDOW
    twice = np.zeros(len(keyed), bool)
    order = np.argsort(keyed, kind="stable")
    same = keyed[order][1:] == keyed[order][:-1]
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    twice &= full
    first = (np.arange(len(keyed)) - at[owner] + offs[owner])[twice]
    change = np.zeros(len(starts) + WINDOW + 1, np.int64)
    np.add.at(change, first, 1)
    np.add.at(change, first + WINDOW, -1)
    out["n_repeat_words"] = G.span_sums(np.cumsum(change)[: len(starts)] > 0, offs)
    return out


def _lines(texts: G.Texts, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word, and those of them that equal an earlier one."""
    breaks = np.flatnonzero(texts.data == 10)
    begins = np.unique(np.concatenate([texts.offs[:-1], breaks + 1]))
    begins = begins[begins < len(texts.data)]
    if not len(begins):
        return np.zeros(texts.n, np.int64), np.zeros(texts.n, np.int64)
    stops = np.append(begins[1:], len(texts.data))
    stops = stops - (texts.data[stops - 1] == 10)
    worded = np.searchsorted(words, stops) > np.searchsorted(words, begins)
    begins, stops = begins[worded], stops[worded]
    owner = np.searchsorted(texts.offs, begins, side="right") - 1
    lines = np.bincount(owner, minlength=texts.n)
    keyed = G.mix(texts.hashes(begins, stops) + owner.astype(G.U) * G.U(0x9E3779B97F4A7C15))
    _, one = np.unique(keyed, return_index=True)
    return lines, lines - np.bincount(owner[one], minlength=texts.n)


def measurements(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and `MEASURES` of each whole text."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in G.batches(frames, text):
            found = measure(texts)
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(found[m], pa.int64()) for m in MEASURES)], [key, *MEASURES])

    return documents.select(key, text).mapInArrow(run, f"{key} {documents.schema[key].dataType.simpleString()}, " + ", ".join(f"{m} long" for m in MEASURES))


def with_bits(measured: DataFrame) -> DataFrame:
    """Adds `failed`: the bits of the rules that fail."""
    bits = [F.when(F.expr(rule), BIT[name]).otherwise(0) for name, rule in RULES.items()]
    total = bits[0]
    for bit in bits[1:]:
        total = total.bitwiseOR(bit)
    return measured.withColumn("failed", total.cast("long"))


def ledger(documents: DataFrame) -> DataFrame:
    return with_bits(measurements(documents))


def passes(policy: Policy, failed: str = "failed") -> Column:
    return F.col(failed).bitwiseAND(F.lit(policy.mask)) == 0


def apply_policy(frame: DataFrame, policy: Policy) -> DataFrame:
    return frame.where(passes(policy))


def ablation(frame: DataFrame, policy: Policy) -> DataFrame:
    """For each rule of the policy: documents that fail it, those that only it rejects, and those kept without it."""
    on = F.col("failed").bitwiseAND(F.lit(policy.mask))
    counts = [f(name) for name in policy.rejects for f in (
        lambda name: F.count_if(on.bitwiseAND(F.lit(BIT[name])) != 0).alias(f"failed_{name}"),
        lambda name: F.count_if(on == BIT[name]).alias(f"only_{name}"),
    )]
    one = frame.agg(F.count_if(on == 0).alias("kept"), *counts)
    rows = F.array(*(F.struct(F.lit(policy.version).alias("policy"), F.lit(name).alias("rule"), F.col(f"failed_{name}").alias("n_failed"), F.col(f"only_{name}").alias("n_only"), (F.col("kept") + F.col(f"only_{name}")).alias("kept_without")) for name in policy.rejects))
    return one.select(F.inline(rows))
