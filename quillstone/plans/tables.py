"""Chunking as a table function of SQL: one call a file, its segments in order.

    SELECT * FROM chunk_segments(row => TABLE(segments) PARTITION BY (root_id, relative_path) ORDER BY seg_no, token_budget => 200, overlap => 16)
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

from ..schema import ConfigurationError, IngestParams
from .chunk import CHUNK_ROWS, Tokens, WordTokens, fold_file

NAME = "chunk_segments"


class ChunkFile:
    """Holds the segments of one file until the last has come, then makes its chunks."""

    tokens: Tokens = WordTokens()

    def __init__(self) -> None:
        self.rows: list[dict] = []
        self.params = IngestParams()

    def eval(self, row: Row, token_budget: int, overlap: int) -> Iterator[tuple]:
        if not self.rows:
            if token_budget <= 0 or not 0 <= overlap < token_budget:
                raise ConfigurationError("the budget must be positive and larger than the overlap")
            self.params = IngestParams(token_budget=token_budget, prose_overlap_tokens=overlap)
        self.rows.append(row.asDict())
        return iter(())

    def terminate(self) -> Iterator[tuple]:
        if self.rows:
            yield from fold_file(self.rows, self.params, self.tokens)


def register(spark: SparkSession, name: str = NAME) -> None:
    """Makes the function known to the session's SQL."""
    spark.udtf.register(name, udtf(ChunkFile, returnType=CHUNK_ROWS, useArrow=True))
