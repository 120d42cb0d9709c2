"""Tables in slots by the hash of a key: a change reads and overwrites the slots of the changed keys, and no others.

Slots are partitions, and a change is Spark's dynamic partition overwrite. What takes their place
is written aside first, as a job can't read what it overwrites. A slot that loses its last row
keeps a row that says so, because a partition is only overwritten by rows of its own.

Readers of a slot that is being overwritten see its old or its new files; for many tables behind
one commit there is `store.Bundle`, which writes whole versions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import StoreError
from .scratch import written


@dataclass(frozen=True)
class SlotTable:
    """A table at a path, of rows of a schema with a key that tells them apart."""

    spark: SparkSession
    path: str
    schema: T.StructType
    key: str = "chunk_id"
    slots: int = 64

    def _slot(self) -> Column:
        return F.pmod(F.xxhash64(F.lit(9), self.key), F.lit(self.slots)).cast("int").alias("_slot")

    def _shaped(self, rows: DataFrame) -> DataFrame:
        shaped = rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema))
        return shaped.select("*", F.lit(True).alias("_here"), self._slot())

    def _stored(self) -> DataFrame:
        shape = T.StructType([*(T.StructField(f.name, f.dataType) for f in self.schema), T.StructField("_here", T.BooleanType()), T.StructField("_slot", T.IntegerType())])
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        if not path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], shape)
        return self.spark.read.schema(shape).parquet(self.path)

    def read(self) -> DataFrame:
        return self._stored().where("_here").drop("_here", "_slot")

    def append(self, rows: DataFrame) -> None:
        """Adds rows of new keys, without a look at the old ones."""
        self._put(self._shaped(rows), "append")

    def upsert(self, rows: DataFrame) -> list[int]:
        """Puts the rows in place of those of their keys; the slots that were overwritten."""
        return self.change(rows, None)

    def delete_ids(self, ids: DataFrame) -> list[int]:
        return self.change(self.read().where("false"), ids)

    def change(self, fresh: DataFrame, gone: DataFrame | None) -> list[int]:
        """Deletes the keys that are gone and upserts the fresh rows, in one overwrite."""
        fresh = written(self._shaped(fresh))
        keys = fresh.select(self.key, "_slot")
        keys = written((keys if gone is None else keys.unionByName(gone.select(self.key, self._slot()))).distinct())
        touched = sorted(r[0] for r in keys.select("_slot").distinct().collect())  # at most as many as slots
        left = self._stored().where(F.col("_slot").isin(touched) & F.col("_here")).join(keys.select(self.key), self.key, "left_anti")
        return self._overwrite(left.unionByName(fresh), touched)

    def delete(self, condition: str | Column) -> list[int]:
        """Deletes the rows for which the condition is true; only the slots that have some are overwritten."""
        bad = F.coalesce(F.expr(condition) if isinstance(condition, str) else condition, F.lit(False))
        touched = sorted(r[0] for r in self._stored().where(F.col("_here") & bad).select("_slot").distinct().collect())
        return self._overwrite(self._stored().where(F.col("_slot").isin(touched) & F.col("_here") & ~bad), touched)

    def compact(self) -> list[int]:
        """Makes one file of each slot that has several; these slots."""
        files = self._stored().select("_slot", F.input_file_name().alias("file")).distinct()
        several = files.groupBy("_slot").agg(F.count("*").alias("n")).where("n > 1")
        touched = sorted(r[0] for r in several.select("_slot").collect())
        return self._overwrite(self._stored().where(F.col("_slot").isin(touched) & F.col("_here")), touched)

    def _overwrite(self, rows: DataFrame, touched: list[int]) -> list[int]:
        if touched:
            none = [F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema]
            empty = self.spark.createDataFrame([(s,) for s in touched], "_slot int").select(*none, F.lit(False).alias("_here"), "_slot")
            self._put(written(rows.unionByName(empty)), "overwrite")
        return touched

    def _put(self, rows: DataFrame, mode: str) -> None:
        try:
            rows.repartition("_slot").sortWithinPartitions("_slot", self.key).write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("_slot").parquet(self.path)
        except Exception as e:
            raise StoreError(f"the table can't be written: {e}") from e
