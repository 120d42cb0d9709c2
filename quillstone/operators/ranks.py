"""Exact order statistics of groups of any size, by histograms that close in on a rank.

Each round counts a group's values in `BUCKETS` equal steps between two bounds, in every task
first, and moves the bounds to the least and greatest value of the bucket that holds the rank.
When they meet, that value is the answer. No group's values are sorted or held together; a
round is one aggregation, and two or three of them are usual.

Defined results: nulls and NaN don't count; a group without values has no statistics.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written

BUCKETS = 1024


def at_ranks(frame: DataFrame, by: list[str], value: str, ranks: dict[str, Column]) -> DataFrame:
    """by, `_n` (the number of values), and for each name the value of that rank (from 1), given in terms of `_n`."""
    rows = frame.select(*by, F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL AND NOT isnan(_v)")
    extent = written(rows.groupBy(*by).agg(F.count("*").alias("_n"), F.min("_v").alias("_low"), F.max("_v").alias("_high")))
    wanted = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), rank.cast("long").alias("rank")) for name, rank in ranks.items())))
    state = written(extent.select(*by, "_low", "_high", wanted.alias("w")).select(*by, F.col("w.name").alias("_name"), F.col("w.rank").alias("_rank"), "_low", "_high"))
    keys = [*by, "_name"]
    while not (open_ := state.where("_low < _high")).isEmpty():
        inside = rows.join(_renamed(open_, by), _same(by)).where("_v BETWEEN _low AND _high").drop(*(f"_k{i}" for i in range(len(by))))
        # halves, so that the distance of the largest doubles is one too
        step = F.floor((F.col("_v") / 2 - F.col("_low") / 2) / (F.col("_high") / 2 - F.col("_low") / 2) * BUCKETS)
        inside = inside.withColumn("_bucket", F.least(step, F.lit(BUCKETS - 1)))
        counts = inside.groupBy(*keys, "_rank", "_bucket").agg(F.count("*").alias("_many"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
        upto = F.sum("_many").over(Window.partitionBy(*keys).orderBy("_bucket"))
        found = counts.withColumn("_upto", upto).where("_upto >= _rank AND _upto - _many < _rank")
        state = written(state.where("_low >= _high").unionByName(found.select(*keys, (F.col("_rank") - (F.col("_upto") - F.col("_many"))).alias("_rank"), "_low", "_high")))
    answers = state.groupBy(*by).agg(*(F.max(F.when(F.col("_name") == name, F.col("_low"))).alias(name) for name in ranks))
    return extent.select(*by, "_n").join(_renamed(answers, by), _same(by)).drop(*(f"_k{i}" for i in range(len(by))))


def _renamed(frame: DataFrame, by: list[str]) -> DataFrame:
    return frame.select(*(F.col(c).alias(f"_k{by.index(c)}") if c in by else F.col(c) for c in frame.columns))


def _same(by: list[str]) -> Column:
    out = F.lit(True)
    for i, c in enumerate(by):
        out = out & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    return out


def median_and_percentile(frame: DataFrame, by: list[str], value: str, fraction: float) -> DataFrame:
    """by, n, median (the mean of the middle two) and nearest-rank percentile."""
    n = F.col("_n")
    ranks = {"_lower": F.floor((n + 1) / 2), "_upper": F.floor(n / 2) + 1, "percentile": F.greatest(F.lit(1), F.ceil(F.lit(fraction) * n))}
    found = at_ranks(frame, by, value, ranks)
    return found.select(*by, F.col("_n").alias("n"), ((F.col("_lower") + F.col("_upper")) / 2).alias("median"), "percentile")
