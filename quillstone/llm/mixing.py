"""Mixing sources to target weights by a low-discrepancy schedule.

Slots k = 0, 1, ... are points of the golden-ratio sequence on a ring of integers; the
cumulative targets cut the ring into one arc per source, and a slot goes to the source whose
arc holds its point. The r-th slot of a source takes the r-th block of equal many words from
the endless repetition of the source's shuffled documents. A prefix of the schedule therefore
holds every source in proportion at any time, and no source is ever sorted or numbered in one
task: both the shuffled order and the ranks of slots are prefix sums over small pieces.

Defined results: a null text has size 0 and is never taken; a null source is a source of its
own, last in order; rows with equal ids are separate documents; an empty table gives no rows;
other columns are ignored, and `mixture` keeps them. Equal input gives equal output, whatever the partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._tables import settled

#: Points of the ring (a prime) and the step: the ring's golden section.
RING = 2_147_483_647
STEP = 1_327_217_884
#: Equal arcs that slots and sources are matched on.
CELLS = 4096
#: Pieces of a source's shuffled order, and slots in a row, that one task numbers.
PIECES = 1 << 13
RUN = 1 << 16
BLOCK = 64
WORD = r"[^\x20\x09-\x0D]+"


def sized(documents: DataFrame) -> DataFrame:
    """doc_id, source, size (words of the whole text), a shuffle key, and a second hash of id and text."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return documents.select("doc_id", "source", size.alias("size"), F.xxhash64("doc_id", "text").alias("shuffle"), F.hash("text", "doc_id").alias("check"))


def tag(source: str | Column) -> Column:
    """The source as a key that isn't null."""
    source = F.col(source) if isinstance(source, str) else source
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, target: the share of all sizes by weight, at most `most` times a source's size.

    What a capped source can't take is shared again by weight: a level is sought such that the
    sum of min(cap, weight * level) is the total. In order of cap / weight, the first source
    that stays under its cap gives the level.
    """
    one = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    one = one.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), place + 1)).withColumn("cap", most * F.col("source_size"))
    by = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, rest = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = share * F.sum("source_size").over(everything)
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    one = one.withColumn("level", level)
    under = F.min(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(everything)
    target = F.least("cap", F.col("weight") * F.coalesce(under["level"], F.lit(float("inf"))))
    return one.select("source", F.col("source_size").cast("long").alias("source_size"), target.alias("target"))


def arcs(goals: DataFrame) -> DataFrame:
    """Each source's arc [lo, hi) of the ring and its number `sid`, in order of source."""
    by = Window.orderBy(F.col("source").asc_nulls_last())
    sums = F.sum("target").over(by.rowsBetween(Window.unboundedPreceding, 0))
    whole = F.sum("target").over(Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    hi = F.when(whole > 0, F.floor(sums / whole * RING)).otherwise(0).cast("long")
    return goals.withColumn("sid", F.row_number().over(by)).withColumn("hi", hi).withColumn("lo", F.coalesce(F.lag("hi").over(by), F.lit(0)))


def schedule(arcs_: DataFrame, n_slots: int) -> DataFrame:
    """slot, sid, rank: the source of each slot, and how many of the source's slots come before it."""
    point = (F.col("slot") % RING) * STEP % RING
    slots = arcs_.sparkSession.range(n_slots).select(F.col("id").alias("slot")).withColumn("point", point).withColumn("cell", F.floor(F.col("point") * CELLS / RING))
    cells = F.sequence(F.floor(F.col("lo") * CELLS / RING), F.floor((F.col("hi") - 1) * CELLS / RING))
    parts = arcs_.where("hi > lo").select("sid", "lo", "hi", F.explode(cells).alias("cell"))
    dealt = slots.join(parts, "cell").where("point >= lo AND point < hi").select("slot", "sid", F.floor(F.col("slot") / RUN).alias("run"))
    counts = dealt.groupBy("sid", "run").count()
    before = counts.select("sid", "run", (F.sum("count").over(Window.partitionBy("sid").orderBy("run")) - F.col("count")).alias("before"))
    inside = dealt.withColumn("n", F.row_number().over(Window.partitionBy("sid", "run").orderBy("slot")))
    return inside.join(before, ["sid", "run"]).select("slot", "sid", (F.col("before") + F.col("n") - 1).alias("rank"))


def streams(sizes: DataFrame, arcs_: DataFrame) -> DataFrame:
    """Each document's first word `at` in its source's shuffled order."""
    key = F.col("shuffle")
    rows = sizes.withColumn("tag", tag("source")).withColumn("piece", F.pmod(F.shiftrightunsigned(key, 40), F.lit(PIECES)))
    sums = rows.groupBy("tag", "piece").agg(F.sum("size").alias("words"))
    before = sums.select("tag", "piece", (F.sum("words").over(Window.partitionBy("tag").orderBy("piece")) - F.col("words")).alias("before"))
    numbered = arcs_.select(tag("source").alias("tag"), "sid", "source_size", "target")
    inside = F.sum("size").over(Window.partitionBy("tag", "piece").orderBy("shuffle", "doc_id", "check", "size").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    ahead = before.join(numbered, "tag")
    return rows.withColumn("inside", inside).join(ahead, ["tag", "piece"]).select("doc_id", "source", "size", "shuffle", "check", "tag", "sid", "source_size", "target", (F.col("before") + F.col("inside")).alias("at"))


def taken(stream: DataFrame, slots: DataFrame, block: int = BLOCK, passes: int = 2) -> DataFrame:
    """The stream's rows with `taken` (their words in the blocks that slots take, over all passes) and `starts` (the passes that take their first word).

    A source's last block is cut where its target is reached.
    """
    rows = stream.withColumn("row", F.struct("sid", "at", "shuffle"))
    turns = rows.where("size > 0").select("row", "sid", F.explode(F.array(*(F.col("at") + p * F.col("source_size") for p in range(passes)))).alias("begin"), "size", F.floor("target").alias("goal"))
    turns = turns.withColumn("end", F.least(F.col("begin") + F.col("size"), "goal")).where("end > begin")
    whole = F.sequence(F.floor(F.col("begin") / block), F.floor((F.col("end") - 1) / block))
    inside = turns.select("row", "sid", "begin", "end", F.explode(whole).alias("rank"))
    words = F.least("end", (F.col("rank") + 1) * block) - F.greatest("begin", F.col("rank") * block)
    got = inside.join(slots, ["sid", "rank"]).groupBy("row").agg(F.sum(words).alias("taken"), F.count_if(F.col("begin") >= F.col("rank") * block).alias("starts"))
    return rows.join(got, "row", "left").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long")).withColumn("starts", F.coalesce("starts", F.lit(0))).drop("row")


def mix(documents: DataFrame, block: int = BLOCK, share: float = 1.5, weights: tuple[int, ...] = (3, 1, 2)) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, starts, at, tag, shuffle, check of every document."""
    sizes = settled(sized(documents))
    arcs_ = arcs(targets(sizes, weights, share))
    total = arcs_.agg(F.sum("target")).first()[0] or 0.0
    n_slots = int(-(-total // block)) + SPARE
    return taken(streams(sizes, arcs_), schedule(arcs_, n_slots), block)


def mixture(documents: DataFrame, block: int = BLOCK) -> DataFrame:
    """The mix as documents: each row is there once for every pass that takes its first word.

    Rows are told apart by source, id and text; of rows that agree in these, the n-th takes the
    n-th turn in its source's order, by their other columns.
    """
    same = [tag("source").alias("_tag"), F.xxhash64("doc_id", "text").alias("_one"), F.hash("text", "doc_id").alias("_two")]
    found = mix(documents, block).where("size > 0").select(F.col("tag").alias("_tag"), F.col("shuffle").alias("_one"), F.col("check").alias("_two"), "at", "starts")
    keys = ["_tag", "_one", "_two"]
    found = found.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("at"))).where("starts > 0")
    others = [F.col(f"_row.{f.name}") for f in documents.schema if f.name not in ("doc_id", "text", "source") and not isinstance(f.dataType, (T.MapType, T.VariantType))]
    rows = documents.select(F.struct("*").alias("_row"), *same).withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("_one", *others)))
    return rows.join(found, [*keys, "_n"]).select("_row.*", F.explode(F.sequence(F.lit(1).cast("long"), "starts")).alias("_turn")).drop("_turn")


#: Slots beyond the total, so that a source that the sequence serves late still nears its target.
SPARE = 8
