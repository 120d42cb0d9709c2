"""Pairs of chunks whose sets of terms are similar, found by their rarest terms.

Chunks with equal sets are one class, and pairs are of classes. A class's terms are put in order of
rarity. Two sets of a similarity of t or more share some terms among their first terms, of which a
set of n has to show only n - ceil(t n) + the number of these, and their sizes differ by a factor of t at most; so a
term that every chunk has pairs none of them. What is left is compared on whole sets.

Defined results: chunks without a term are similar to none; ids may repeat, the least stands for
its class, and chunks without an id are counted in their class only; a class whose ids are all null isn't shown.
Terms meet by their hashes; an equal hash of two terms makes a pair be compared, never be left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import subject_terms
from ..sources.scratch import written

#: Terms that are told apart by how common they are, at most.
RANKED = 1 << 17
#: First terms that a pair has to share to be compared on whole sets, if it has to share as many at all.
MEETINGS = 4


def classes(chunks: DataFrame, terms: Column, id_column: str = "chunk_id") -> DataFrame:
    """id (the least of the class), n (its chunks), terms (sorted, none twice) of the classes that have a term."""
    sets = chunks.select(F.col(id_column).alias("id"), F.array_sort(F.array_distinct(terms)).alias("terms")).where(F.size("terms") > 0)
    found = sets.groupBy(F.sha2(F.to_json("terms"), 256).alias("_set")).agg(F.min("id").alias("id"), F.count("*").alias("n"), F.first("terms").alias("terms"))
    return found.where("id IS NOT NULL").select("id", "n", "terms")


def _hashed() -> Column:
    return F.transform("terms", lambda t: F.xxhash64(t))


def frequent(sets: DataFrame) -> np.ndarray:
    """Hashes of the commonest terms, rarest first; at most `RANKED`. Terms are counted by their hashes, in every task first."""
    common = sets.select(F.explode(_hashed()).alias("key")).groupBy("key").agg(F.count("*").alias("df"))
    return common.orderBy(F.desc("df"), "key").limit(RANKED).toPandas().sort_values(["df", "key"])["key"].to_numpy(np.int64)


def prefixes(sets: DataFrame, threshold: float) -> DataFrame:
    """key (a term's hash), id, size, place (from 0) of the terms by which a set may be found, the rarest first.

    Any one order of all terms finds all pairs; rarity only keeps them few. So terms that aren't among the
    commonest go first, by their hashes, and no set is taken apart and put together again.
    """
    ranked = frequent(sets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_key = np.argsort(ranked)
        known = ranked[by_key]
        for batch in batches:
            lists, size = batch.column(1), batch.column(2).to_numpy()
            keys, row = lists.flatten().to_numpy(), np.repeat(np.arange(len(size)), size)
            at = np.minimum(np.searchsorted(known, keys), max(len(known) - 1, 0))
            rank = np.where(known[at] == keys, by_key[at], -1) if len(known) else np.full(len(keys), -1)
            order = np.lexsort((keys, rank, row))
            place = np.arange(len(keys)) - np.repeat(np.cumsum(size) - size, size)
            shown = place < np.repeat(batch.column(3).to_numpy(), size)
            row = row[shown]
            yield pa.RecordBatch.from_arrays([pa.array(keys[order][shown]), batch.column(0).take(pa.array(row)), pa.array(size[row]), pa.array(place[shown].astype(np.int32))], ["key", "id", "size", "place"])

    n = F.size("terms")
    sized = sets.select("id", _hashed().alias("keys"), n.alias("size"), (n - least_common(n, threshold) + MEETINGS).alias("shown"))
    return sized.mapInArrow(run, T.StructType([T.StructField("key", T.LongType()), sets.schema["id"], T.StructField("size", T.IntegerType()), T.StructField("place", T.IntegerType())]))


def least_common(size: Column, threshold: float) -> Column:
    """The terms that a set of the size has at least in common with a similar one; rounding never asks for too many."""
    return F.greatest(F.lit(1), F.ceil(size * threshold - 1e-9)).cast("int")


def candidates(sets: DataFrame, threshold: float) -> DataFrame:
    """a, b of the classes that could be similar, by their first shared terms, sizes, and what can follow these terms.

    Sets that have `o` terms in common still have o - j + 1 to come at the j-th of them, that one too. So the first
    `MEETINGS` of them (all, if there are fewer) lie where at least o - MEETINGS + 1 terms are left in both sets,
    and a pair that shares fewer terms there has no `o` in common.
    """
    shown = written(prefixes(sets, threshold))
    a, b = (shown.select("key", *(F.col(c).alias(f"{c}_{k}") for c in ("id", "size", "place"))) for k in ("a", "b"))
    # both sides are dealt alike, so one exchange serves both; the smaller set is the first of a pair
    met = a.join(b, "key").where((F.col("size_a") < F.col("size_b")) | ((F.col("size_a") == F.col("size_b")) & (F.col("id_a") < F.col("id_b"))))
    met = met.where((F.col("id_a") != F.col("id_b")) & (F.col("size_a") >= threshold * F.col("size_b") - 1e-9))
    common = least_common(F.col("size_a") + F.col("size_b"), threshold / (1 + threshold))
    need = F.least(common, F.lit(MEETINGS))
    met = met.where(F.least(F.col("size_a") - F.col("place_a"), F.col("size_b") - F.col("place_b")) >= common - need + 1)
    pairs = met.groupBy(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")).agg(F.count("*").alias("n"), F.max(need).alias("need"))
    return pairs.where("n >= need").select("a", "b")


def similar_pairs(chunks: DataFrame, threshold: float, terms: Column | None = None, id_column: str = "chunk_id") -> DataFrame:
    """a, b (classes, a < b), n_a, n_b (their chunks), overlap, similarity of the pairs of a similarity of the threshold or more."""
    sets = written(classes(chunks, subject_terms(F.col("text")) if terms is None else terms, id_column))
    found = candidates(sets, threshold)
    left, right = (sets.select(F.col("id").alias(k), F.col("n").alias(f"n_{k}"), F.to_json("terms").alias(f"json_{k}")) for k in ("a", "b"))
    both = found.join(left, "a").join(right, "b")  # as text, a set is a third of what it is as an array of texts
    both = both.withColumns({f"terms_{k}": F.from_json(f"json_{k}", "array<string>") for k in ("a", "b")}).withColumn("overlap", F.size(F.array_intersect("terms_a", "terms_b")).cast("long"))
    union = F.size("terms_a") + F.size("terms_b") - F.col("overlap")
    return both.where(F.col("overlap") >= threshold * union - 1e-9).select("a", "b", "n_a", "n_b", "overlap", (F.col("overlap") / union).alias("similarity"))
