"""Nearest chunks by vector: exact for a batch of queries, or over cells of an inverted file."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException, ParseException

from ..functions import vectors as V
from ..schema import METRICS, ConfigurationError, QueryError
from . import scan

#: Queries that are sent to the tasks together at most; a larger batch meets the chunks block by block.
QUERY_BLOCK = 1 << 16
ORDER_DIGITS = 9


def where(chunks: DataFrame, filter_sql: str | None) -> DataFrame:
    """The rows for which the SQL condition is true; a condition that doesn't parse is a query error."""
    if filter_sql is None:
        return chunks
    try:
        return chunks.where(F.expr(filter_sql))
    except (AnalysisException, ParseException) as e:
        raise QueryError(f"the filter is not valid: {e}") from e


def rank_key(distance: Column) -> Column:
    """Distances that differ by rounding only tie, so that the id decides on every engine."""
    return F.round(distance, ORDER_DIGITS)


def floats(rows: DataFrame, vector: str) -> Column:
    """The vectors as they are, or in double precision if their components are neither float nor double."""
    return F.col(vector) if rows.schema[vector].dataType.simpleString() in ("array<float>", "array<double>") else V.doubles(vector)


def ranked(found: DataFrame, k: int, metric: str, id_column: str) -> DataFrame:
    """The k best of each query among what the tasks left; what has no distance or no id comes last."""
    by = Window.partitionBy("query_id").orderBy(F.col("_key").asc_nulls_last(), F.col(id_column).asc_nulls_last())
    best = found.withColumn("dense_rank", F.row_number().over(by) - 1).where(F.col("dense_rank") < k).drop("_key")
    return best.withColumn("score", V.score(metric, F.col("dense_distance")))


def topk(chunks: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", filter_sql: str | None = None, prefilter: bool = True, keep: tuple[str, ...] = (), id_column: str = "chunk_id") -> DataFrame:
    """query_id, id, dense_distance, dense_rank (from 0), score, and the kept columns of the k nearest chunks.

    `queries` has query_id and query_vector. They are sent to the tasks in bounded blocks, and the
    chunks are never shuffled: each task multiplies its own with the queries, and its k best meet the others'.
    A prefilter holds before the k are chosen, a postfilter after, which may leave fewer.
    """
    if k <= 0:
        raise QueryError("the number of results must be positive")
    if metric not in METRICS:
        raise ConfigurationError(f"unknown metric {metric!r}")
    rows = where(chunks, filter_sql) if prefilter else chunks
    extra = [c for c in keep if c != id_column]
    rows = rows.select(id_column, *extra, floats(rows, "vector").alias("_v"))
    asked = queries.select("query_id", V.doubles("query_vector").alias("_q"))
    best = ranked(scan.nearest(rows, asked, k, metric, id_column, extra, "_v", QUERY_BLOCK), k, metric, id_column)
    return best if prefilter else where(best, filter_sql)


def build_cells(chunks: DataFrame, cells: int, seed: int = 1, id_column: str = "chunk_id") -> tuple[DataFrame, DataFrame]:
    """(chunks with `cell`, centres): an inverted file by k-means, for a search that reads some cells only.

    Write the first partitioned by `cell`: a search then prunes the others at the scan.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    points = chunks.withColumn("_features", array_to_vector(V.doubles("vector")))
    model = KMeans(k=cells, seed=seed, featuresCol="_features", predictionCol="cell").fit(points)
    centres = chunks.sparkSession.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "cell int, centre array<double>")
    return model.transform(points).drop("_features"), centres


def search_cells(celled: DataFrame, centres: DataFrame, queries: DataFrame, k: int, nprobes: int = 8, refine_factor: int = 1, metric: str = "cosine", exact: bool = False, id_column: str = "chunk_id") -> DataFrame:
    """Nearest chunks among those of each query's `nprobes` nearest cells; `exact` scans all.

    Distances here are exact, so a refine factor only widens what is looked at before the cut.
    """
    if exact:
        return topk(celled, queries, k, metric, id_column=id_column)
    asked = queries.select("query_id", V.doubles("query_vector").alias("_q"))
    listed = centres.orderBy("cell").select("cell", V.doubles("centre").alias("centre")).toPandas()
    numbers, middle = listed["cell"].to_numpy(), np.stack(listed["centre"].to_numpy())

    def probes(points: np.ndarray) -> np.ndarray:
        """Which cells (by number) each vector looks at: those of the nearest centres, ties to the least number."""
        gaps = np.stack([scan.summed(points.T, np.broadcast_to(c[:, None], points.T.shape), scan.gap) for c in middle], 1)
        out = np.zeros((len(points), int(numbers.max()) + 1), bool)
        np.put_along_axis(out, numbers[np.argsort(gaps, 1, kind="stable")[:, :nprobes]], True, 1)
        return out

    rows = celled.select(id_column, "cell", floats(celled, "vector").alias("_v"))
    found = scan.nearest(rows, asked, k * max(1, refine_factor), metric, id_column, [], "_v", QUERY_BLOCK, "cell", probes)
    return ranked(found, k, metric, id_column).select("query_id", id_column, "dense_distance", "dense_rank", "score")
