"""Results by folder: rows of folders, places of documents, and the order of presentation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.order import natural_key
from .positions import placed


def positions(frame: DataFrame, name: str, part: list[str], coarse: dict[str, str], fine: list[Column]) -> DataFrame:
    """Adds `name`: the place (from 0) of each row in the order coarse, fine within each part.

    `coarse` maps columns to asc or desc. Rows are dealt by ranges of the whole order, so neither
    a part nor the coarse values of one meet in one task.
    """
    order = [F.col(c).desc() if way == "desc" else F.col(c).asc() for c, way in coarse.items()]
    return placed(frame, part, [*order, *fine], name)


def folder_rows(results: DataFrame, folder: str = "folder", document: str = "file_path") -> DataFrame:
    """folder, hits, documents."""
    return results.groupBy(folder).agg(F.count("*").alias("hits"), F.count_distinct(document).alias("documents"))


def grouped_order(results: DataFrame, folder: str = "folder", document: str = "file_path") -> DataFrame:
    """Adds `position` (from 0) within each query: folders by their best score, then name; inside by natural path and chunk."""
    best = results.groupBy("query_id", folder).agg(F.max("score").alias("_best")).withColumnsRenamed({"query_id": "_q", folder: "_f"})
    same = F.col("query_id").eqNullSafe(F.col("_q")) & F.col(folder).eqNullSafe(F.col("_f"))
    rows = results.join(best, same).withColumn("_key", natural_key(F.col(document)))
    placed = positions(rows, "position", ["query_id"], {"_best": "desc", folder: "asc", "_key": "asc"}, [F.col("chunk_index")])
    return placed.drop("_best", "_key", "_q", "_f")


def document_places(results: DataFrame, folder: str = "folder", document: str = "file_path", order: str = "position") -> DataFrame:
    """Adds `document_index` (from 1, in order of first sight) and `document_total` within each folder.

    Documents are numbered by their first places, a row each, however many results they have.
    """
    keys = ["query_id", folder, document]
    seen = results.groupBy(*keys).agg(F.min(order).alias("_first_seen"))
    numbered = placed(seen, keys[:2], ["_first_seen"], "_index", "document_total")
    numbered = numbered.select((F.col("_index") + 1).alias("document_index"), "document_total", *(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)))
    same = reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)))
    return results.join(numbered, same).drop("_k0", "_k1", "_k2")
