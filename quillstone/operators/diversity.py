"""Diversity of ranked results: maximal marginal relevance, caps and roll-ups of documents."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .positions import placed
from .scan import rounded

#: Values of candidates that differ by less tie, so that the order decides on every engine.
VALUE_DIGITS = 7
SEPARATOR = "\n\n---\n\n"


def relevance_lambda(diversity: float) -> float:
    """The weight of relevance for a wish for diversity, both from 0 to 1."""
    return min(1.0, max(0.0, 1.0 - diversity))


def select_mmr(vectors: list, query, scores: np.ndarray, weight: float, limit: int) -> list[int]:
    """Places of the chosen candidates, in order of choice.

    Relevance is the cosine to the query, or the score of a candidate without a vector. The most
    relevant comes first; then always the one with the largest weight * relevance - (1 - weight) *
    (largest cosine to a chosen one), ties in `VALUE_DIGITS` digits to the earliest. Each choice updates
    all candidates' largest cosine at once, so a pool of n costs n * limit products.
    """
    n = len(vectors)
    if limit <= 0:
        return []
    if n <= 1:
        return list(range(n))
    has = np.array([v is not None for v in vectors])
    width = next((len(v) for v in vectors if v is not None), 0)
    unit = np.zeros((n, width))
    for i, v in enumerate(vectors):
        if v is not None:
            x = np.asarray(v, np.float64)
            size = float(np.linalg.norm(x))
            unit[i] = x / size if size else 0
    relevance = scores.astype(np.float64).copy()
    if query is not None and width:
        q = np.asarray(query, np.float64)
        size = float(np.linalg.norm(q))
        relevance[has] = (unit @ (q / size if size else q * 0))[has]
    closest = np.full(n, -np.inf)
    free = np.ones(n, bool)
    picked: list[int] = []
    while len(picked) < min(limit, n):
        penalty = np.where(has & np.isfinite(closest), closest, 0.0) if picked else np.zeros(n)
        value = weight * relevance - (1 - weight) * penalty if picked else relevance
        place = int(np.argmax(np.where(free, rounded(value, VALUE_DIGITS), -np.inf)))
        picked.append(place)
        free[place] = False
        if has[place]:
            closest = np.maximum(closest, unit @ unit[place])
    return picked


def mmr(results: DataFrame, weight: float, limit: int, query_vector: str = "query_vector") -> DataFrame:
    """The results re-ranked for each query; `rank` is new, scores stay. A query's pool is small by then (fetch_k)."""
    shape = T.StructType(list(results.schema))

    def run(pool: pd.DataFrame) -> pd.DataFrame:
        pool = pool.sort_values("rank", kind="stable").reset_index(drop=True)
        chosen = select_mmr(list(pool["vector"]), pool[query_vector].iloc[0], pool["score"].to_numpy(), weight, limit)
        out = pool.iloc[chosen].copy()
        out["rank"] = range(len(out))
        return out

    return results.groupBy("query_id").applyInPandas(run, shape)


def cap_per_document(results: DataFrame, most: int, document: str = "file_path") -> DataFrame:
    """The first `most` results of each document in rank order, with ranks closed up."""
    by = Window.partitionBy("query_id", document).orderBy("rank")
    kept = results.withColumn("_n", F.row_number().over(by)).where(F.col("_n") <= most).drop("_n")
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")) - 1)


def rollup_best(results: DataFrame, document: str = "file_path") -> DataFrame:
    """One result a document: the first in the current order."""
    return cap_per_document(results, 1, document)


def rollup_aggregate(results: DataFrame, document: str = "file_path") -> DataFrame:
    """One result a document: its best chunk's columns, the texts in order of the chunks, and the sum of tokens."""
    rest = [c for c in results.columns if c not in ("query_id", document, "text", "token_count", "chunk_kind", "rank", "score")]
    texts = F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "rank", "text"))), lambda s: s["text"])
    best = F.max_by(F.struct(*rest), F.struct("score", (-F.col("rank")).alias("r"))) if rest else F.lit(None)
    out = results.groupBy("query_id", document).agg(best.alias("_best"), F.max("score").alias("score"), F.array_join(texts, SEPARATOR).alias("text"), F.sum("token_count").alias("token_count"), F.min("rank").alias("rank"))
    out = out.select("query_id", document, *(f"_best.{c}" for c in rest), "score", "text", "token_count", F.lit("document").alias("chunk_kind"), F.col("rank").alias("_first"))
    columns = [*out.columns[:-1], "rank"]
    return placed(out, ["query_id"], ["_first"], "rank").select(*columns)
