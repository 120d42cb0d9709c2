"""Incremental work by joins: what is new, changed, unchanged or gone."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.blocks import PostingBlocks
from ..operators.lexical import postings
from ..sources.scratch import written
from ..sources.slots import SlotTable
from ..sources.store import Snapshots, upserted
from . import compat
from .embed import Embedder, embed_documents


def diff(records: DataFrame, index: DataFrame) -> DataFrame:
    """The records with `change`: added, updated (the texts differ) or unchanged.

    Only ids and digests of the index take part, never its texts or vectors.
    """
    digest = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)
    known = index.select("chunk_id", digest.alias("_known"))
    both = records.withColumn("_now", digest).join(known, "chunk_id", "left")
    change = F.when(F.col("_known").isNull(), "added").when(F.col("_known") != F.col("_now"), "updated").otherwise("unchanged")
    return both.withColumn("change", change).drop("_known", "_now")


def removed(before: DataFrame, after: DataFrame, key: str = "chunk_id") -> DataFrame:
    """The rows of before whose key is gone."""
    return before.join(after.select(key), key, "left_anti")


def classify(files: DataFrame, state: DataFrame) -> DataFrame:
    """The files with `status`: new, changed (bytes or parameters) or unchanged."""
    keys = ["root_id", "relative_path"]
    known = state.select(*keys, F.col("content_hash").alias("_hash"), F.col("params_fingerprint").alias("_params"))
    status = F.when(F.col("_hash").isNull(), "new").when((F.col("_hash") != F.col("content_hash")) | (F.col("_params") != F.col("params_fingerprint")), "changed").otherwise("unchanged")
    return files.join(known, keys, "left").withColumn("status", status).drop("_hash", "_params")


def gone(state: DataFrame, seen: DataFrame, registry: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """chunk_id, root_id, relative_path of files that are positively absent; those that failed keep their chunks."""
    keys = ["root_id", "relative_path"]
    absent = state.select(*keys).join(seen.select(*keys), keys, "left_anti")
    if failed is not None:
        absent = absent.join(failed.select(*keys), keys, "left_anti")
    return registry.join(absent, keys, "left_semi").select("chunk_id", *keys)


@dataclass(frozen=True)
class Summary:
    added: int
    updated: int
    unchanged: int
    deleted: int
    total: int
    documents: int


def sync(records: DataFrame, gone_ids: DataFrame | None, index: Snapshots | SlotTable, embedder: Embedder, terms: PostingBlocks | Snapshots | None = None) -> Summary:
    """Brings the index up to the records: deletes, embeds what is new or changed, upserts, brings the postings up to date.

    One new version of the table holds the deletions and the upserts together; a table in slots
    has only those of the changed ids overwritten. Posting blocks
    change by the ids that changed; a plain table of postings is made anew.
    """
    now = index.read()
    compat.verify(now, embedder.identity)
    changes = diff(records, now)
    counts = {r[0]: r[1] for r in changes.groupBy("change").count().collect()}
    fresh = changes.where("change <> 'unchanged'").drop("change")
    left = now if gone_ids is None else now.join(gone_ids.select("chunk_id").distinct(), "chunk_id", "left_anti")
    deleted = 0 if gone_ids is None else now.join(gone_ids.select("chunk_id").distinct(), "chunk_id", "left_semi").count()
    if deleted or len(set(counts) - {"unchanged"}):
        new = embed_documents(fresh, embedder).withColumn("created_at", F.unix_timestamp().cast("double")).withColumn("model_identity", F.lit(embedder.identity))
        if isinstance(terms, PostingBlocks):
            fresh = written(fresh.select("chunk_id", "text"))  # what differs from the index as it was
        _put(index, left, new, gone_ids)
        if isinstance(terms, PostingBlocks):
            terms.change(fresh, None if gone_ids is None else gone_ids.select("chunk_id").distinct())
        elif terms is not None:
            terms.replace(postings(index.read()))
    total, documents = index.read().agg(F.count("*"), F.count_distinct("file_path")).first()
    return Summary(counts.get("added", 0), counts.get("updated", 0), counts.get("unchanged", 0), deleted, total, documents)


def _put(index: Snapshots | SlotTable, left: DataFrame, new: DataFrame, gone_ids: DataFrame | None) -> None:
    if isinstance(index, SlotTable):
        index.change(new, gone_ids)
    else:
        index.replace(upserted(left, new))
