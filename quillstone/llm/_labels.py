"""Bounded samples of labelled documents for fitting classifiers.

A sample takes the rows whose hash lies below the share that the bound is of all rows. Unlike an
ordering with a limit this needs one count, moves no rows between tasks and sends the driver no
more than the sample, however many tasks there are. The bound holds up to the share's variance.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._tables import remainder

#: Documents of each label that a classifier is fitted on at most, and the longest text among them in bytes.
SAMPLE = 3000
LONGEST = 1 << 16
#: Documents whose crc32(id as text) has this remainder are held out from fitting.
HELD_OUT = (3, 1)


def held_out(key: str = "doc_id"):
    return remainder(key, HELD_OUT[0]) == HELD_OUT[1]


def in_share(hashed: Column, bound: int, of: int) -> Column:
    """Whether a 64-bit hash lies in the share bound / of."""
    if of <= bound:
        return F.lit(True)
    return F.pmod(hashed, F.lit(1 << 32)) < int((1 << 32) * bound / of)


def labelled(documents: DataFrame, labels: DataFrame, label: str, sample: dict[int, int] | int = SAMPLE, longest: int = LONGEST) -> list[tuple[bytes, int]]:
    """(text, label) of a fixed sample of the rows that aren't held out, of bounded size; the order is fixed.

    Of a document with several labels the largest counts; null labels and texts don't. The ids
    are chosen first, by hash, so that the one pass over the documents broadcasts only them.
    """
    sizes = sample if isinstance(sample, dict) else {0: sample, 1: sample}
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max(label).alias("_label"))
    counts = {r[0]: r[1] for r in known.where(F.col("_label").isin(*sizes)).groupBy("_label").count().collect()}
    chosen = known.where(reduce(Column.__or__, ((F.col("_label") == value) & in_share(F.xxhash64("doc_id"), size, counts.get(value, 0)) for value, size in sizes.items())))
    rows = documents.select("doc_id", "text").where(F.octet_length("text") <= longest).join(F.broadcast(chosen), "doc_id")
    found = sorted({(r["doc_id"], bytes(r["b"]), int(r["_label"])) for r in rows.select("doc_id", F.col("text").cast("binary").alias("b"), "_label").collect()})
    return [(text, value) for _, text, value in found]
