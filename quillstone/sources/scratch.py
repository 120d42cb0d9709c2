"""Intermediate tables in the folder that the cluster names, so that a lost executor loses none of them."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder, from spark.checkpoint.dir. A local session, whose one machine shares all, gets a new one if that is unset."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir()


def new_path(spark: SparkSession) -> str:
    """A path below the shared folder that nothing has used."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}.parquet"


def written(frame: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The frame, written as Parquet below the shared folder (with a partition for each value of `by`) and read again."""
    path = new_path(frame.sparkSession)
    frame.write.partitionBy(*(by or [])).parquet(path)
    return frame.sparkSession.read.schema(_nullable(frame)).parquet(path)


def _nullable(frame: DataFrame) -> T.StructType:
    """The frame's own schema: partition columns keep their types, and a table without rows its columns."""
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in frame.schema])
