"""Filter interaction audit: what each filter removes in every order of the filters.

Documents get five failure flags (True: the filter removes it). They are counted by part and
flags; a CUBE over the flags and the part then holds, in the grouping sets that keep the part and
some flags, in the rows whose kept flags are all false, the survivors of just these filters. Each
step of each order is the pair of subsets before and after it, and joins the survivors of both.

The last flag, identity to a smaller id's text, needs the smallest id of each text. Texts are
known by SHA-256; rows of one text are counted by part in every task first, beside the smallest id
and the rows that have it, so a text that a third of all rows share costs a row a part and task.

Defined results: null texts are empty; a null part is the empty string and one with it; a repeated row
counts as often as it is there; rows of equal ids aren't smaller than each other; a null id is
neither smaller than another nor has a smaller one; a document with several rows of labels has a
label that any of them has; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
FILTERS = "ABCDE"
FULL = (1 << len(FILTERS)) - 1
COUNTS = ("n", "good", "toxic")


def text_flags(text: Column, words: Column) -> dict[str, Column]:
    """Failure of each filter that looks at one text, given the array of its words."""
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 3 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def flagged(documents: DataFrame, part: str = "lang") -> DataFrame:
    """doc_id, part, digest (of the text), A, B, C, D of every row."""
    text = F.coalesce("text", F.lit(""))
    rows = documents.select("doc_id", F.coalesce(F.col(part), F.lit("")).alias("part"), text.alias("text"))
    flags = text_flags(F.col("text"), F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    return rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), *(c.alias(k) for k, c in flags.items()))


def labelled(labels: DataFrame) -> DataFrame:
    """doc_id, good, toxic (0 or 1): one row a labelled document."""
    most = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0))
    return labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(most("quality").alias("good"), most("toxic").alias("toxic")).where("good + toxic > 0")


def outcomes(documents: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """part, A to E, and the number of documents with these flags: n, good, toxic."""
    own = [*FILTERS[:4]]
    rows = flagged(documents, part)
    # rows without an id have no label and never fail E, so they need no partner
    without = rows.where("doc_id IS NULL").groupBy("part", *own).agg(F.count("*").alias("n"), F.lit(0).cast("long").alias("good"), F.lit(0).cast("long").alias("toxic"))
    known = rows.where("doc_id IS NOT NULL").join(labelled(labels), "doc_id", "left")
    ids = known.groupBy("doc_id", "part", "digest", *own).agg(F.count("*").alias("n"), F.sum(F.coalesce("good", F.lit(0))).alias("good"), F.sum(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    texts = ids.groupBy("digest", "part", *own).agg(*(F.sum(c).alias(c) for c in COUNTS), F.min(F.struct("doc_id", *COUNTS)).alias("first"))
    first = F.col("first.doc_id") == F.min("first.doc_id").over(Window.partitionBy("digest"))
    texts = texts.withColumn("leads", first)
    sides = F.explode(F.array(F.struct(F.lit(False).alias("E"), *(F.when(F.col("leads"), F.col(f"first.{c}")).otherwise(0).alias(c) for c in COUNTS)), F.struct(F.lit(True).alias("E"), *((F.col(c) - F.when(F.col("leads"), F.col(f"first.{c}")).otherwise(0)).alias(c) for c in COUNTS))))
    counted = texts.select("part", *own, sides.alias("side")).select("part", *own, "side.*").where("n > 0")
    return counted.unionByName(without.withColumn("E", F.lit(False))).groupBy("part", *FILTERS).agg(*(F.sum(c).alias(c) for c in COUNTS))


def survivors(counted: DataFrame) -> DataFrame:
    """part, mask (bit i: filter i is applied), n, good, toxic of the documents that fail none of the mask's filters.

    A subset without survivors has no row.
    """
    cube = counted.cube(*FILTERS, "part").agg(F.grouping_id().alias("rolled"), *(F.sum(c).alias(c) for c in COUNTS))
    # bits of grouping_id are 1 where a column was rolled up; the part is the lowest, A the highest
    kept = F.lit(0)
    for i, name in enumerate(FILTERS):
        kept = kept + F.when(F.col(name).isNotNull(), 1 << i).otherwise(0)
    clean = F.lit(True)
    for name in FILTERS:
        clean = clean & ~F.coalesce(F.col(name), F.lit(False))
    return cube.where((F.col("rolled") % 2 == 0) & clean).select("part", kept.alias("mask"), *COUNTS)


def orders() -> list[tuple[int, str, int, str, int, int]]:
    """(place, order, step, its filter, mask before, mask after) of every step of every order of the filters."""
    out = []
    for order in permutations(FILTERS):
        before = 0
        for step, name in enumerate(order, 1):
            after = before | 1 << FILTERS.index(name)
            out.append((len(out), "".join(order), step, name, before, after))
            before = after
    return out


def audit(documents: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """A row for each part, filter_order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    subsets = survivors(outcomes(documents, labels, part))
    listed = orders()
    steps = documents.sparkSession.createDataFrame(listed, "place int, filter_order string, step int, filter string, before int, after int")
    # every part has the row of the empty subset, which all its steps start from
    parts = subsets.where("mask = 0").select("part", F.explode(F.sequence(F.lit(0), F.lit(len(listed) - 1))).alias("place")).join(F.broadcast(steps), "place")
    side = lambda name: subsets.select("part", F.col("mask").alias(name), F.struct(*COUNTS).alias(f"_{name}"))
    pairs = parts.join(side("before"), ["part", "before"], "left").join(side("after"), ["part", "after"], "left")
    lost = {c: F.coalesce(F.col(f"_before.{c}"), F.lit(0)) - F.coalesce(F.col(f"_after.{c}"), F.lit(0)) for c in COUNTS}
    found = pairs.select("part", "filter_order", "step", "filter", F.coalesce("_after.n", F.lit(0)).alias("kept"), lost["n"].alias("removed"), lost["good"].alias("good_lost"), lost["toxic"].alias("toxic_lost"))
    by = Window.partitionBy("part", "filter")  # 120 rows: as first of an order a filter removes all that fail it, as last those that fail no other
    fails, only = (F.max(F.when(F.col("step") == k, F.col("removed"))).over(by) for k in (1, len(FILTERS)))
    return found.select("part", "filter_order", "step", "kept", "removed", (fails - F.col("removed")).alias("redundant"), only.alias("unique_fails"), "good_lost", "toxic_lost", F.sum("removed").over(by).alias("shapley"))
