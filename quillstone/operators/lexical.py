"""BM25 over a materialised table of postings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import QueryError
from ..sources.scratch import written
from .dense import where

K1, B = 1.2, 0.75
TERM = r"([\p{L}\p{N}]+)"
ORDER_DIGITS = 9


def terms(text: Column | str) -> Column:
    """The lower-case runs of letters and digits of a text, in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))), F.lit(TERM), F.lit(1))


def postings(chunks: DataFrame, id_column: str = "chunk_id", text: str = "text") -> DataFrame:
    """term, id, tf, doc_len: one row for each term of each chunk, counted in its own task before the shuffle.

    A semi-join with query terms on top is pushed below the count by the optimizer.
    """
    words = chunks.select(id_column, terms(text).alias("_t")).withColumn("doc_len", F.size("_t").cast("long"))
    return words.select(id_column, "doc_len", F.explode("_t").alias("term")).groupBy(id_column, "doc_len", "term").agg(F.count("*").alias("tf")).select("term", id_column, "tf", "doc_len")


def corpus_stats(chunks: DataFrame, text: str = "text") -> DataFrame:
    """n_docs, avg_len: one row."""
    size = F.size(terms(text))
    return chunks.agg(F.count("*").alias("n_docs"), F.avg(size).alias("avg_len"))


def document_frequency(table: DataFrame) -> DataFrame:
    return table.groupBy("term").agg(F.count("*").alias("df"))


def held_terms(chunks: DataFrame, wanted: DataFrame, id_column: str = "chunk_id", text: str = "text") -> DataFrame:
    """term, id, tf, doc_len of the wanted terms, and a row of the empty term for each chunk: texts are read and cut into terms once.

    What is kept is written, so that counts, statistics and scores come from it and not from the texts again.
    """
    words = chunks.select(id_column, terms(text).alias("_t")).withColumn("doc_len", F.size("_t").cast("long"))
    each = words.select(id_column, "doc_len", F.explode(F.concat(F.array(F.lit("")), "_t")).alias("term"))
    every = wanted.unionAll(wanted.sparkSession.range(1).select(F.lit("").alias("term")))
    return written(each.join(every, "term", "left_semi").groupBy(id_column, "doc_len", "term").agg(F.count("*").alias("tf")).select("term", id_column, "tf", "doc_len"))


def idf(n_docs: Column, df: Column) -> Column:
    return F.log(1 + (n_docs - df + 0.5) / (df + 0.5))


def bm25(chunks: DataFrame, queries: DataFrame, k: int, filter_sql: str | None = None, table: DataFrame | None = None, stats: DataFrame | None = None, k1: float = K1, b: float = B, id_column: str = "chunk_id", allowed: DataFrame | None = None) -> DataFrame:
    """query_id, id, lexical_score, lexical_rank (from 0) of the k best chunks that hold any query term.

    `queries` has query_id and query. Query terms are distinct; statistics are those of the whole
    corpus; the filter, and the ids in `allowed`, only choose candidates, before anything is scored.
    Without a materialised table of postings, one pass over the texts takes the query's terms, and
    everything else comes from these. `stats` has one row, so it is broadcast; the postings meet
    the weighted query terms by term.
    """
    if k <= 0:
        raise QueryError("the number of results must be positive")
    asked = queries.select("query_id", F.explode(F.array_distinct(terms("query"))).alias("term"))
    wanted = asked.select("term").distinct()
    if table is None:
        seen = held_terms(chunks, wanted, id_column)
        table = seen.where("term <> ''")
        stats = seen.where("term = ''").agg(F.count("*").alias("n_docs"), F.avg("doc_len").alias("avg_len")) if stats is None else stats
    else:
        stats = corpus_stats(chunks) if stats is None else stats
    frequency = document_frequency(table.join(wanted, "term", "left_semi"))
    held = table.join(wanted, "term", "left_semi")
    if filter_sql is not None:
        held = held.join(where(chunks, filter_sql).select(id_column), id_column, "left_semi")
    if allowed is not None:
        held = held.join(allowed.select(id_column), id_column, "left_semi")
    weights = frequency.join(F.broadcast(stats)).select("term", "avg_len", idf(F.col("n_docs"), F.col("df")).alias("idf"))
    hits = held.join(asked.join(weights, "term"), "term")
    tf = F.col("tf").cast("double")
    part = F.col("idf") * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("doc_len") / F.col("avg_len")))
    found = hits.groupBy("query_id", id_column).agg(F.sum(part).alias("lexical_score"))
    by = Window.partitionBy("query_id").orderBy(F.round("lexical_score", ORDER_DIGITS).desc(), id_column)
    return found.withColumn("lexical_rank", F.row_number().over(by) - 1).where(F.col("lexical_rank") < k)
