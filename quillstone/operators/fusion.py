"""Fusion of dense and lexical candidates: one full outer join, then arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import ConfigurationError

RRF_K, ALPHA = 60, 0.5
ORDER_DIGITS = 9
CLOSE_ABS, CLOSE_REL = 1e-9, 1e-9


def merged(dense: DataFrame, lexical: DataFrame, id_column: str = "chunk_id") -> DataFrame:
    """Candidates of either list; the dense row leads, and its nulls are filled from the lexical one."""
    keys = ["query_id", id_column]
    left, right = dense.withColumn("_dense", F.lit(True)), lexical.withColumn("_lexical", F.lit(True))
    both = [c for c in left.columns if c in right.columns and c not in keys]
    right = right.withColumnsRenamed({c: f"_r_{c}" for c in both})
    out = left.join(right, keys, "full_outer")
    for c in both:
        out = out.withColumn(c, F.coalesce(c, f"_r_{c}"))
    return out.drop(*(f"_r_{c}" for c in both)).withColumn("_dense", F.coalesce("_dense", F.lit(False))).withColumn("_lexical", F.coalesce("_lexical", F.lit(False)))


def _cut(out: DataFrame, limit: int | None, id_column: str) -> DataFrame:
    by = Window.partitionBy("query_id").orderBy(F.round("score", ORDER_DIGITS).desc(), id_column)
    out = out.drop("_dense", "_lexical").withColumn("rank", F.row_number().over(by) - 1)
    return out.where(F.col("rank") < limit) if limit and limit > 0 else out


def rrf(dense: DataFrame, lexical: DataFrame, k: int = RRF_K, dense_weight: float = 1.0, lexical_weight: float = 1.0, limit: int | None = None, id_column: str = "chunk_id") -> DataFrame:
    """Reciprocal ranks from 0: w / (k + rank + 1) from each list that has the chunk; a null rank counts as 0."""
    if k <= 0:
        raise ConfigurationError("k must be positive")
    if dense_weight < 0 or lexical_weight < 0:
        raise ConfigurationError("weights must not be negative")
    part = lambda there, rank, w: F.when(F.col(there), w / (k + F.coalesce(rank, F.lit(0)) + 1)).otherwise(0.0)
    out = merged(dense, lexical, id_column)
    return _cut(out.withColumn("score", part("_dense", "dense_rank", dense_weight) + part("_lexical", "lexical_rank", lexical_weight)), limit, id_column)


def min_max(value: Column, low: Column, high: Column) -> Column:
    """The value's place between the extremes; 1 where these are as good as equal."""
    close = F.abs(high - low) <= F.greatest(F.lit(CLOSE_ABS), CLOSE_REL * F.greatest(F.abs(high), F.abs(low)))
    return F.when(close, F.lit(1.0)).otherwise((value - low) / (high - low))


def linear(dense: DataFrame, lexical: DataFrame, alpha: float = ALPHA, limit: int | None = None, id_column: str = "chunk_id") -> DataFrame:
    """alpha * dense + (1 - alpha) * lexical, each scaled to 0..1 over its own list; a missing side is 0."""
    if not 0 <= alpha <= 1:
        raise ConfigurationError("alpha must be from 0 to 1")
    by = Window.partitionBy("query_id")
    scaled = lambda c: min_max(F.col(c), F.min(c).over(by), F.max(c).over(by))
    left = dense.withColumn("_d", scaled("score"))
    right = lexical.withColumn("_l", scaled("lexical_score"))
    out = merged(left, right, id_column)
    return _cut(out.withColumn("score", alpha * F.coalesce("_d", F.lit(0.0)) + (1 - alpha) * F.coalesce("_l", F.lit(0.0))).drop("_d", "_l"), limit, id_column)
