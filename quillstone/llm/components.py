"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._groups import tell
from ._tables import settled


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node of the component of each node that has an edge (columns a, b).

    Each round replaces edges by edges to smaller nodes and is kept in the checkpoint folder, so
    a lost executor costs one round at most. Rounds go on until nothing changes; they grow with
    the logarithm of the diameter.
    """
    now = settled(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    while True:
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        told = tell(both, ["a"], {"least": F.min("b")}, "b")  # in parts: a node may have most of all edges
        large = told.where("b > a").select(F.col("b").alias("a"), F.least("least", "a").alias("b")).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        now = settled(small.where("a <> b").distinct())
        new = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if new == mark:
            break
        mark = new
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).groupBy("node").agg(F.min("root").alias("root"))
