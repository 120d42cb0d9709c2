"""Context windows: a chunk's text with that of its neighbours in the same document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import QueryError

JOINER = "\n\n"


def _joined(texts: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(texts), lambda s: s["text"]), JOINER)


def expand(results: DataFrame, chunks: DataFrame, window: int, document: str = "file_path", index: str = "chunk_index") -> DataFrame:
    """Adds `expanded_context`: the texts whose index is at most `window` away, in order.

    Each result asks for its 2 * window + 1 indices by equality, so this is one equi-join on
    (document, index) for all results instead of a range join or a look-up each. The filter of
    the search doesn't hold here; a result without rows keeps its own text.
    """
    if window < 0:
        raise QueryError("a context window can't be negative")
    if window == 0:
        return results.withColumn("expanded_context", F.col("text"))
    keys = results.select("query_id", document, index).distinct()
    wanted = keys.select("query_id", document, F.col(index).alias("_at"), F.explode(F.sequence(F.greatest(F.lit(0).cast("long"), F.col(index) - window), F.col(index) + window)).alias(index))
    rows = chunks.select(document, index, "text").join(wanted, [document, index])
    found = rows.groupBy("query_id", document, "_at").agg(_joined(F.collect_list(F.struct(index, "text"))).alias("expanded_context"))
    out = results.join(found.withColumnRenamed("_at", index), ["query_id", document, index], "left")
    return out.withColumn("expanded_context", F.coalesce("expanded_context", "text"))


def window_of_all(chunks: DataFrame, window: int, document: str = "file_path", index: str = "chunk_index") -> DataFrame:
    """`expanded_context` of every chunk, by a range frame over each document."""
    if window < 0:
        raise QueryError("a context window can't be negative")
    by = Window.partitionBy(document).orderBy(index).rangeBetween(-window, window)
    return chunks.withColumn("expanded_context", _joined(F.collect_list(F.struct(index, "text")).over(by)))
