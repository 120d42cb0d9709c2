"""Incremental ingestion as a stream: new files or records, upserted batch by batch.

A file source sees no deletions; these stay with the batch run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..plans.embed import Embedder
from ..plans.sync import sync
from ..sources.store import Snapshots


def upsert_stream(records: DataFrame, index: Snapshots, embedder: Embedder, checkpoint: str) -> StreamingQuery:
    """Each micro-batch is one synchronisation; a batch that is run again changes nothing, as ids and texts are the same."""

    def batch(rows: DataFrame, _: int) -> None:
        last = rows.groupBy("chunk_id").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "chunk_id"]), F.col("text")).alias("r")).select("chunk_id", "r.*")
        sync(last.select(*rows.columns), None, index, embedder)

    return records.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(batch).start()


def record_stream(spark: SparkSession, folder: str, schema: StructType, files_per_batch: int = 100) -> DataFrame:
    """Records that appear as Parquet files in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def windowed_power(samples: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Count and mean of `value` by event time and kind, with a bound on late rows."""
    return samples.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
