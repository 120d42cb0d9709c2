"""Reading the tables, and cutting lineage in the folder that the cluster names."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus`; a null id counts as the empty text."""
    return F.crc32(F.coalesce((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string"), F.lit("")).cast("binary")) % modulus


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder, from spark.checkpoint.dir. A local session, whose one machine shares all, gets a new one if that is unset."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir()


def written(frame: DataFrame) -> DataFrame:
    """The frame, written as Parquet below the shared folder and read again."""
    path = f"{shared_folder(frame.sparkSession)}/{uuid.uuid4().hex}.parquet"
    frame.write.parquet(path)
    return frame.sparkSession.read.parquet(path)


def settled(frame: DataFrame) -> DataFrame:
    """The frame, computed once and kept in the shared folder, without its lineage."""
    shared_folder(frame.sparkSession)
    return frame.checkpoint(eager=True)
