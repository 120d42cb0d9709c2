"""Snapshot tables in Parquet: append, upsert, delete, compact and statistics.

Parquet has no rows to change in place, so a change writes the next version of the table beside
the last, and then a pointer file of the next number is moved into place. Readers follow the
pointer of the largest number: they see one version or the other, and never none.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.dense import where
from ..schema import StoreError

MB = 1 << 20
TARGET_MB = 128


def upserted(old: DataFrame, new: DataFrame, key: str | list[str] = "chunk_id") -> DataFrame:
    """All of the new rows, and the old ones whose key they don't have."""
    return old.join(new.select(key) if isinstance(key, str) else new.select(*key), key, "left_anti").unionByName(new.select(*old.columns))


def without(rows: DataFrame, condition: str | Column) -> DataFrame:
    """The rows for which the condition is not true (false or null)."""
    if isinstance(condition, str):
        where(rows, condition)
        condition = F.expr(condition)
    return rows.where(~F.coalesce(condition, F.lit(False)))


def stats(chunks: DataFrame) -> DataFrame:
    """chunks, documents, identities (sorted, stamped ones), unstamped: one row."""
    identity = F.coalesce("model_identity", F.lit(""))
    return chunks.agg(F.count("*").alias("chunks"), F.count_distinct("file_path").alias("documents"), F.array_sort(F.collect_set(F.when(identity != "", identity))).alias("identities"), F.count_if(identity == "").alias("unstamped"))


class Bundle:
    """Named tables of versions below a folder of any file system that Spark reaches, behind one pointer.

    A commit writes the next versions and then moves the pointer, so all tables change or none.
    """

    def __init__(self, spark: SparkSession, folder: str, schemas: Mapping[str, StructType]):
        self.spark, self.folder, self.schemas = spark, folder.rstrip("/"), dict(schemas)
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, prefix: str) -> list[str]:
        """Names below the folder that begin so, in order."""
        folder = self._path(self.folder)
        if not self._fs.exists(folder):
            return []
        found = (s.getPath().getName() for s in self._fs.listStatus(folder))
        return sorted(n for n in found if n.startswith(prefix))

    def _pointer(self, name: str) -> dict[str, str]:
        return json.loads(self.spark.read.text(f"{self.folder}/{name}", wholetext=True).first()[0])

    def versions(self) -> dict[str, str]:
        """The version of each table that the last pointer names."""
        pointers = self._names("CURRENT-")
        return self._pointer(pointers[-1]) if pointers else {}

    def read(self, name: str) -> DataFrame:
        """The current version; an empty table if there is none yet."""
        version = self.versions().get(name)
        if version is None:
            return self.spark.createDataFrame([], self.schemas[name])
        return self.spark.read.schema(self.schemas[name]).parquet(f"{self.folder}/{version}")

    def shaped(self, name: str, rows: DataFrame) -> DataFrame:
        return rows.select(*(F.col(f.name).cast(f.dataType) for f in self.schemas[name]))

    def commit(self, tables: Mapping[str, DataFrame]) -> None:
        """Writes these tables' next versions and points to them; of the older versions only the last stay."""
        pointers = self._names("CURRENT-")
        number = int(pointers[-1].removeprefix("CURRENT-")) if pointers else 0
        old = self._pointer(pointers[-1]) if pointers else {}
        new = dict(old)
        try:
            for name, rows in tables.items():
                new[name] = f"v-{uuid.uuid4().hex}"
                self.shaped(name, rows).write.parquet(f"{self.folder}/{new[name]}")
        except Exception as e:
            raise StoreError(f"the table can't be written: {e}") from e
        waiting = self._path(f"{self.folder}/{uuid.uuid4().hex}.pointer")
        out = self._fs.create(waiting, True)
        out.write(json.dumps(new).encode())
        out.close()
        if not self._fs.rename(waiting, self._path(f"{self.folder}/CURRENT-{number + 1:012d}")):
            raise StoreError("another writer has replaced the table")
        kept = {*old.values(), *new.values()}
        for name in [n for n in self._names("v-") if n not in kept] + self._names("CURRENT-")[:-2]:
            self._fs.delete(self._path(f"{self.folder}/{name}"), True)

    def drop(self) -> None:
        self._fs.delete(self._path(self.folder), True)


class Snapshots:
    """One table of versions: a bundle of one."""

    def __init__(self, spark: SparkSession, folder: str, schema: StructType):
        self.bundle = Bundle(spark, folder, {"rows": schema})
        self.spark, self.folder, self.schema = spark, self.bundle.folder, schema

    def version(self) -> str | None:
        return self.bundle.versions().get("rows")

    def read(self) -> DataFrame:
        return self.bundle.read("rows")

    def replace(self, rows: DataFrame) -> None:
        self.bundle.commit({"rows": rows})

    def append(self, rows: DataFrame) -> None:
        version = self.version()
        if version is None:
            self.replace(rows)
        else:
            self.bundle.shaped("rows", rows).write.mode("append").parquet(f"{self.folder}/{version}")

    def upsert(self, rows: DataFrame, key: str | list[str]) -> None:
        self.replace(upserted(self.read(), rows, key))

    def delete(self, condition: str | Column) -> int:
        """Deletes by condition; the number of rows that went."""
        now = self.read()
        left = without(now, condition)
        before = now.count()
        self.replace(left)
        return before - self.read().count()

    def delete_ids(self, ids: DataFrame, key: str) -> int:
        now = self.read()
        before = now.count()
        self.replace(now.join(ids.select(key).distinct(), key, "left_anti"))
        return before - self.read().count()

    def compact(self, target_mb: int = TARGET_MB) -> int:
        """Rewrites the table in files of about the target size; their number."""
        files = max(1, -(-self.bytes() // (target_mb * MB)))
        self.replace(self.read().repartition(files))
        return files

    def bytes(self) -> int:
        version = self.version()
        fs, path = self.bundle._fs, self.bundle._path
        return 0 if version is None else fs.getContentSummary(path(f"{self.folder}/{version}")).getLength()

    def drop(self) -> None:
        self.bundle.drop()
