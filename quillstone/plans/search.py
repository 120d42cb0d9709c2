"""The search plan: candidates, fusion, re-ranking, diversity, caps and context, for a batch of queries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import dense, diversity, expansion, fusion, lexical
from ..operators.blocks import PostingBlocks
from ..schema import FUSIONS, METRICS, MODES, ConfigurationError, QueryError

Rerank = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Options:
    mode: str = "hybrid"
    metric: str = "cosine"
    fusion: str = "rrf"
    limit: int = 10
    fetch_k: int | None = None
    rrf_k: int = 60
    dense_weight: float = 1.0
    lexical_weight: float = 1.0
    linear_alpha: float = 0.5
    mmr_diversity: float | None = None
    max_chunks_per_document: int | None = None
    rollup: bool = False
    context_window: int = 0
    filter_sql: str | None = None
    prefilter: bool = True
    include_vector: bool = False

    def __post_init__(self) -> None:
        for value, known, what in ((self.mode, MODES, "mode"), (self.metric, METRICS, "metric"), (self.fusion, FUSIONS, "fusion")):
            if value not in known:
                raise ConfigurationError(f"unknown {what} {value!r}")
        if self.limit <= 0:
            raise QueryError("the number of results must be positive")
        if self.context_window < 0:
            raise QueryError("a context window can't be negative")

    @property
    def depth(self) -> int:
        return self.fetch_k or max(4 * self.limit, 30)


def candidates(chunks: DataFrame, queries: DataFrame, o: Options, table: DataFrame | PostingBlocks | None = None) -> DataFrame:
    """query_id, chunk_id, score, rank and the diagnostics of either list; queries that are blank find nothing."""
    asked = queries.where(F.trim("query") != "")
    near = words = None
    if o.mode != "lexical_only":
        near = dense.topk(chunks, asked, o.depth, o.metric, o.filter_sql, o.prefilter).select("query_id", "chunk_id", "dense_distance", "dense_rank", "score")
    if o.mode != "dense_only":
        if isinstance(table, PostingBlocks):
            found = table.search(asked, o.depth, None if o.filter_sql is None else dense.where(chunks, o.filter_sql))
        else:
            found = lexical.bm25(chunks, asked, o.depth, o.filter_sql, table)
        words = found.select("query_id", "chunk_id", "lexical_score", "lexical_rank")
    if words is None:
        return near.withColumn("rank", F.col("dense_rank")).withColumn("lexical_score", F.lit(None).cast("double")).withColumn("lexical_rank", F.lit(None).cast("int"))
    if near is None:
        return words.withColumn("score", F.col("lexical_score")).withColumn("rank", F.col("lexical_rank")).withColumn("dense_distance", F.lit(None).cast("double")).withColumn("dense_rank", F.lit(None).cast("int"))
    if o.fusion == "rrf":
        return fusion.rrf(near, words, o.rrf_k, o.dense_weight, o.lexical_weight, o.depth)
    return fusion.linear(near, words, o.linear_alpha, o.depth)


def search(chunks: DataFrame, queries: DataFrame, options: Options | None = None, table: DataFrame | PostingBlocks | None = None, rerank: Rerank | None = None) -> DataFrame:
    """Ranked chunks of each query (query_id, query, query_vector where the mode needs it).

    Candidates carry ids and scores only; the chunks' columns are joined once, to the few that
    survive fusion. `total_candidates` is their number before diversity and caps.
    """
    o = options or Options()
    found = candidates(chunks, queries, o, table)
    found = found.withColumn("total_candidates", F.count("*").over(Window.partitionBy("query_id")))
    hits = chunks.join(F.broadcast(found) if _few(queries, o) else found, "chunk_id")
    if rerank is not None:
        hits = rerank(hits)
    if o.mmr_diversity and "query_vector" in queries.columns:
        hits = diversity.mmr(hits.join(queries.select("query_id", "query_vector"), "query_id"), diversity.relevance_lambda(o.mmr_diversity), o.depth).drop("query_vector")
    if o.max_chunks_per_document is not None:
        hits = diversity.cap_per_document(hits, o.max_chunks_per_document)
    if o.rollup:
        hits = diversity.rollup_best(hits)
    hits = hits.where(F.col("rank") < o.limit)
    hits = expansion.expand(hits, chunks, o.context_window) if o.context_window else hits.withColumn("expanded_context", F.lit(None).cast("string"))
    return hits if o.include_vector else hits.drop("vector")


#: Candidate rows that may be broadcast; beyond, the join is left to the optimizer.
BROADCAST_ROWS = 100_000


def _few(queries: DataFrame, o: Options) -> bool:
    most = BROADCAST_ROWS // (2 * o.depth)
    return queries.limit(most + 1).count() <= most
