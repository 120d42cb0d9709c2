"""What a group's rows have to know of it, told to them in parts, so that a group of most rows isn't one task's work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parts of a group that learn its answer separately.
SALTS = 128


def tell(rows: DataFrame, keys: list[str], found: dict[str, Column], by: str) -> DataFrame:
    """The rows with what their group has by `found`, without a group's rows meeting in one task.

    `found` has aggregates that can be taken of themselves once more; parts of a group, told apart
    by the hash of a column, are summed up first and get the group's answer separately.
    """
    names = list(found)
    parts = rows.withColumn("_salt", F.pmod(F.xxhash64(F.lit(11), by), F.lit(SALTS)).cast("int"))
    part = parts.groupBy(*keys, "_salt").agg(*(c.alias(n) for n, c in found.items()))
    whole = Window.partitionBy(*keys)
    merged = {n: (F.min(n) if n.startswith("least") else F.sum(n)).over(whole) for n in names}
    answer = part.select(*keys, "_salt", *(c.alias(n) for n, c in merged.items()))
    return parts.join(answer, [*keys, "_salt"]).drop("_salt")
