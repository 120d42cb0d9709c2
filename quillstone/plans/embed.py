"""Embedding: model profiles, templates, and embedders that run in Arrow batches."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import render_template
from ..schema import ConfigurationError, model_identity
from .chunk import DOCUMENT, Tokens


@dataclass(frozen=True)
class Profile:
    model_id: str
    dimension: int
    context: int
    pooling: str
    dense_stages: bool
    document_template: str
    query_template: str
    compiled_length: int = 512
    gated: bool = False

    def __post_init__(self) -> None:
        if "{content}" not in self.document_template or "{content}" not in self.query_template or "{title}" in self.query_template:
            raise ConfigurationError("a template needs {content}, and a query has no {title}")

    @property
    def max_tokens(self) -> int:
        return min(self.compiled_length, self.context)

    def document(self, content: Column, title: Column | None = None) -> Column:
        return render_template(self.document_template, content, title)

    def query(self, content: Column) -> Column:
        return render_template(self.query_template, content)


#: The declared public models.
PROFILES = {
    "embeddinggemma-300m": Profile("google/embeddinggemma-300m", 768, 2048, "mean", True, "title: {title} | text: {content}", "task: search result | query: {content}", gated=True),
    "nomic-embed-text-v1.5": Profile("nomic-ai/nomic-embed-text-v1.5", 768, 8192, "mean", False, "search_document: {content}", "search_query: {content}"),
    "gte-modernbert-base": Profile("Alibaba-NLP/gte-modernbert-base", 768, 8192, "cls", False, "{content}", "{content}"),
}


def profile_for(name: str) -> Profile:
    if name not in PROFILES:
        raise ConfigurationError(f"unknown model {name!r}; there are: {', '.join(sorted(PROFILES))}")
    return PROFILES[name]


class Embedder(Protocol):
    """`embed` maps a string column (rendered templates) to unit vectors; `profile` renders them."""

    profile: Profile

    @property
    def identity(self) -> str: ...

    def embed(self, text: Column) -> Column: ...


@dataclass(frozen=True)
class HashingEmbedder:
    """A deterministic embedder without a model: signed hashes of words and word pairs, at length 1."""

    dimension: int = 64
    profile: Profile = Profile("hashing", 64, 1 << 30, "mean", False, "{content}", "{content}", 1 << 30)

    @property
    def identity(self) -> str:
        return model_identity("hashing", self.dimension)

    def embed(self, text: Column) -> Column:
        size = self.dimension

        def vector(t: str | None) -> np.ndarray:
            words = (t or "").lower().split()
            out = np.zeros(size, np.float32)
            for w in words + [" ".join(p) for p in zip(words, words[1:], strict=False)]:
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                out[h % size] += 1.0 if h >> 63 else -1.0
            norm = float(np.linalg.norm(out))
            if not norm:
                out[0] = norm = 1.0
            return out / norm

        @F.pandas_udf("array<float>")
        def run(texts: pd.Series) -> pd.Series:
            return texts.map(vector)

        return run(text)


def embed_documents(records: DataFrame, embedder: Embedder) -> DataFrame:
    """The records with `vector`, of their title and text in the model's template; empty texts are refused."""
    text = F.when(F.trim("text") == "", F.raise_error(F.lit("an empty text can't be embedded")).cast("string")).otherwise(F.col("text"))
    title = F.col("title") if "title" in records.columns else None
    return records.withColumn("vector", embedder.embed(embedder.profile.document(text, title)))


def embed_queries(queries: DataFrame, embedder: Embedder) -> DataFrame:
    """query_id, query, query_vector."""
    return queries.withColumn("query_vector", embedder.embed(embedder.profile.query(F.col("query"))))


def measured(records: DataFrame, text: str, tokens: Tokens, most: int, template: str = DOCUMENT, title: str | None = None) -> DataFrame:
    """The records with `n_tokens` of the rendered template, special tokens too, and `truncated`: a model of `most` tokens would cut it."""

    @F.pandas_udf("long")
    def count(rendered: pd.Series) -> pd.Series:
        return rendered.map(lambda t: len(tokens.encode(t)) + tokens.extra, na_action="ignore").astype("Int64")

    name = F.col(title) if title is not None else None
    return records.withColumn("n_tokens", count(render_template(template, F.col(text), name))).withColumn("truncated", F.col("n_tokens") > most)


def truncation_report(counted: DataFrame) -> DataFrame:
    """records, truncated, longest: one row; which ones were cut stays in the table."""
    return counted.agg(F.count("*").alias("records"), F.count_if("truncated").alias("truncated"), F.max("n_tokens").alias("longest"))


def progress(records: DataFrame, batch: int) -> DataFrame:
    """done, total: how many records are embedded after each batch of so many."""
    size = records.agg(F.count("*").alias("total"))
    steps = F.explode(F.sequence(F.lit(batch).cast("long"), F.col("total") + batch - 1, F.lit(batch).cast("long")))
    return size.where("total > 0").select(steps.alias("done"), "total").select(F.least("done", "total").alias("done"), "total")
