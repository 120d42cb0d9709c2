"""Positions in an order over all rows, without a sort or a window in one task.

Rows are dealt by range, with bounds that Spark samples, and sorted within each partition; a row
knows its partition and its place there. Positions are these places plus the rows of the
partitions before, of which the driver gets one number a partition. What was dealt is written
below the shared folder first: ranges are sampled anew whenever they are computed again.
"""

from __future__ import annotations

from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written

#: Bits of a row's place in its partition, in the ids that Spark deals out.
_BITS = 33


def positions(rows: DataFrame, order: list[str | Column], name: str = "position", start: int = 0) -> DataFrame:
    """The rows with their position in the order, counted from `start`; no row with a rank of its own shares a position.

    Rows that are equal in all of the order get neighbouring positions in any order. A partition
    is cut between rows, never by value alone, as long as the order tells rows apart: a value
    that many rows share should be followed by columns that tell these apart.
    """
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    kept = written(dealt)
    part, place = F.shiftrightunsigned("_id", _BITS), F.col("_id").bitwiseAND((1 << _BITS) - 1)
    counts = sorted(kept.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    before = accumulate((n for _, n in counts), initial=start)
    offsets = rows.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(counts, before, strict=False)], "_part long, _before long")
    at = kept.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return at.withColumn(name, F.col("_before") + place).drop("_id", "_part", "_before")


def placed(rows: DataFrame, part: list[str], order: list[str | Column], name: str, size: str | None = None) -> DataFrame:
    """The rows with their place (from 0) within their part in the order, and with `size`, the number of its rows.

    Parts are ranges of the one order over all rows, so a part of most rows is cut like any other;
    what is joined back is a row a part.
    """
    found = positions(rows, [*part, *order], "_pos")
    if not part and size is None:
        return found.withColumnRenamed("_pos", name)
    firsts = found.groupBy(*part).agg(F.min("_pos").alias("_pos_first"), F.count("*").alias("_pos_size"))
    firsts = firsts.select("_pos_first", "_pos_size", *(F.col(c).alias(f"_pos_part{i}") for i, c in enumerate(part)))
    same = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"_pos_part{i}")) for i, c in enumerate(part)), F.lit(True))
    out = found.join(firsts, same).withColumn(name, F.col("_pos") - F.col("_pos_first"))
    out = out if size is None else out.withColumn(size, F.col("_pos_size"))
    return out.drop("_pos", "_pos_first", "_pos_size", *(f"_pos_part{i}" for i in range(len(part))))
