"""The prefix trie of conversations, built level by level.

Conversations are rebuilt first: some first turns of the conversation whose id is the last
multiple of `GROUP`, then their own turns after as many. Equal sequences of turns are one unit of
several conversations from then on. At each level, the live units are grouped by (node of the
level before, next turn); a group is a node, named by its depth and its smallest conversation. A
unit that is alone in its node is live no more: the rest of its path is a chain that needs no
grouping, so levels go only as deep as unlike sequences share turns. The way back joins level by
level: leaves and savings of the nodes below are summed into their parents.

No group is collected: a group's live units are spread over parts that learn their node
separately, and the ids of equal conversations, however many, are hashed as a stream of pieces
in order (that hash is a chain by its definition, so a node's pieces pass through one task, a piece
of at most `PIECE` ids at a time).

Defined results: turns are ordered by turn (null first), then by the digest of role and text; null
role or text is empty; repeated rows are turns of their own; rows without a conv_id belong to no
conversation; `c % 20` has the sign of c; a node's parent is null for the root only; other columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.positions import positions
from ._groups import tell
from ._tables import settled, written

GROUP, HEAD = 20, 4
WORD = r"[^\x20\x09-\x0D]+"
#: Ids in a piece of a node's list.
PIECE = 1024
NONE = hashlib.sha256(b"").hexdigest()
NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def digest_of(role: Column, text: Column) -> Column:
    """SHA-256 of a role and a text, told apart by the role's length."""
    return F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)


def own_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, at (place in the order over all turns), key (16 bytes of the turn's digest), words."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id IS NOT NULL").select("conv_id", "turn", F.substring(F.unhex(digest_of(role, text)), 1, 16).alias("key"), F.regexp_count(text, F.lit(WORD)).alias("words"))
    return positions(rows, ["conv_id", F.col("turn").asc_nulls_first(), "key"], "at").drop("turn")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth, key, words) of every rebuilt turn, and (conv_id, length) of every conversation."""
    own = written(turns.groupBy("conv_id").agg(F.min("at").alias("first"), F.count("*").alias("n")))
    heads = own.select("conv_id", "first", "n", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEAD).alias("h"), (F.col("conv_id") - F.col("conv_id") % GROUP).alias("base"))
    bases = own.select(F.col("conv_id").alias("base"), F.col("first").alias("base_first"), F.col("n").alias("base_n"))
    plan = heads.join(bases, "base", "left").withColumn("m", F.least("h", F.coalesce("base_n", F.lit(0))))
    plan = written(plan.select("conv_id", "first", "n", "h", "m", "base_first"))
    borrowed = plan.where("m > 0").select("conv_id", F.posexplode(F.sequence(F.col("base_first"), F.col("base_first") + F.col("m") - 1)).alias("place", "at"))
    borrowed = borrowed.join(turns.drop("conv_id"), "at").select("conv_id", (F.col("place") + 1).cast("long").alias("depth"), "key", "words")
    number = F.col("at") - F.col("first") + 1
    kept = turns.join(plan, "conv_id").where(number > F.col("h")).select("conv_id", (F.col("m") + number - F.col("h")).alias("depth"), "key", "words")
    return written(borrowed.unionAll(kept)), plan.select("conv_id", (F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"))


def sequences(path: DataFrame, lengths: DataFrame) -> DataFrame:
    """seq (128 bits of a hash of the whole sequence, with its length), conv_id of every conversation."""
    # places make the sum of the turns' hashes depend on their order
    ends = path.groupBy("conv_id").agg(*(F.bit_xor(F.xxhash64(F.lit(k), "depth", "key")).alias(f"x{k}") for k in (1, 2)))
    return lengths.join(ends, "conv_id", "left").select("conv_id", F.struct("length", *(F.coalesce(f"x{k}", F.lit(0)).alias(f"x{k}") for k in (1, 2))).alias("seq"))


def hashed_lists(members: DataFrame) -> DataFrame:
    """seq, ends_sha256: SHA-256 of each sequence's conversations, ascending and joined by commas."""
    placed = positions(members, ["seq", "conv_id"], "at")

    def pieces(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pieces of the lists of rows (seq, conv_id, at): runs of one sequence whose places follow each other, joined."""
        seq, ids, begin = None, [], 0
        out: list[tuple] = []

        def close() -> None:
            if ids:
                out.append((seq, begin, ",".join(map(str, ids))))
                ids.clear()

        def batch() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], seq_type), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.string())], ["seq", "at", "piece"])
            out.clear()
            return made

        seq_type = pa.struct([("length", pa.int64()), ("x1", pa.int64()), ("x2", pa.int64())])
        for frame in frames:
            for s, c, a in zip(*(col.to_pylist() for col in frame.columns), strict=True):
                if s != seq or a != begin + len(ids) or len(ids) >= PIECE:
                    close()
                    seq, begin = s, a
                ids.append(c)
            if out:
                yield batch()
        close()
        if out:
            yield batch()

    def hashes(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The hash of each sequence's pieces, which come in order."""
        seq, state, found = None, hashlib.sha256(), []
        names = ("length", "x1", "x2")

        def batch() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([s for s, _ in found], pa.struct([(k, pa.int64()) for k in names])), pa.array([h for _, h in found], pa.string())], ["seq", "ends_sha256"])
            found.clear()
            return made

        for frame in frames:
            for s, piece in zip(frame.column(0).to_pylist(), frame.column(1), strict=True):
                if s == seq:
                    state.update(b",")
                else:
                    if seq is not None:
                        found.append((seq, state.hexdigest()))
                    seq, state = s, hashlib.sha256()
                state.update(piece.as_py().encode())
            if found:
                yield batch()
        if seq is not None:
            found.append((seq, state.hexdigest()))
            yield batch()

    shape = "seq struct<length:bigint,x1:bigint,x2:bigint>"
    cut = placed.select("seq", "conv_id", "at").mapInArrow(pieces, f"{shape}, at bigint, piece string")
    return cut.repartition("seq").sortWithinPartitions("seq", "at").select("seq", "piece").mapInArrow(hashes, f"{shape}, ends_sha256 string")


def levels(units: DataFrame, path: DataFrame) -> tuple[list[DataFrame], DataFrame, DataFrame]:
    """The shared nodes of each depth (node, parent, n_convs, words), and the units' ways out of them.

    Those that end in one: rep, depth, node. Those that are alone from a depth on: rep, depth, parent, n, length.
    """
    spark = units.sparkSession
    root, n_convs = units.agg(F.min("rep"), F.sum("n")).first()
    shared = [spark.createDataFrame([(root, None, n_convs, 0)] if n_convs else [], "node long, parent long, n_convs long, words int")]
    ended = [units.where("length = 0").select("rep", F.lit(0).alias("depth"), F.lit(root).cast("long").alias("node"))]
    alone = []
    live = units.where("length > 0").withColumn("node", F.lit(root).cast("long"))
    while True:
        depth = len(shared)
        turns = path.where(F.col("depth") == depth).select(F.col("conv_id").alias("rep"), "key", "words")
        met = live.withColumnRenamed("node", "parent").join(turns, "rep")
        met = written(tell(met, ["parent", "key"], {"least": F.min("rep"), "units": F.count("*"), "n_convs": F.sum("n")}, "rep"))
        alone.append(met.where("units = 1").select("rep", F.lit(depth).alias("depth"), "parent", "n", "length"))
        several = met.where("units > 1").withColumnRenamed("least", "node")
        nodes = written(several.groupBy("node", "parent").agg(F.max("n_convs").alias("n_convs"), F.max("words").alias("words")))
        if nodes.isEmpty():
            return shared, reduce(DataFrame.unionAll, ended), reduce(DataFrame.unionAll, alone)
        shared.append(nodes)
        ended.append(several.where(F.col("length") == depth).select("rep", F.lit(depth).alias("depth"), "node"))
        live = several.where(F.col("length") > depth).select("rep", "n", "length", "node")


def chains(alone: DataFrame, path: DataFrame) -> DataFrame:
    """`NODE` of the nodes of units that are alone from a depth on (rep, depth, parent, n, length, ends_sha256), and `top` (whether it is the first of its chain)."""
    turns = path.select(F.col("conv_id").alias("rep"), F.col("depth").alias("at"), "words")
    rows = alone.join(turns, "rep").where("at >= depth")
    below = Window.partitionBy("rep").orderBy(F.col("at").desc()).rowsBetween(Window.unboundedPreceding, 0)
    saved = F.sum((F.col("n") - 1) * F.col("words")).over(below)
    rows = rows.where("n = 1").withColumn("saved", F.lit(0).cast("long")).unionAll(rows.where("n > 1").withColumn("saved", saved))
    top, last = F.col("at") == F.col("depth"), F.col("at") == F.col("length")
    return rows.select(
        F.col("rep").alias("conv_id"), F.col("at").cast("long").alias("depth"), F.when(top, F.col("parent")).otherwise(F.col("rep")).alias("parent_conv_id"), F.col("n").alias("n_convs"), F.when(last, 0).otherwise(1).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.when(last, F.col("ends_sha256")).otherwise(NONE).alias("ends_sha256"), top.alias("top"),
    )


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """`NODE` of every node of the trie of the rebuilt conversations."""
    path, lengths = rebuilt(own_turns(conversations))
    members = written(sequences(path, lengths))
    classes = members.groupBy("seq").agg(F.min("conv_id").alias("rep"), F.count("*").alias("n"))
    units = written(classes.join(hashed_lists(members), "seq").select("rep", "n", F.col("seq.length").alias("length"), "ends_sha256"))
    shared, ended, alone = levels(units.drop("ends_sha256"), path)
    ends = units.select("rep", "ends_sha256")
    single = written(chains(alone.join(ends, "rep"), path))
    tops = single.where("top").select("depth", F.col("parent_conv_id").alias("parent"), "n_leaves", "saved_tokens")
    ended = written(ended.join(ends, "rep").select("depth", "node", "ends_sha256"))
    done: list[DataFrame] = []
    for depth in range(len(shared) - 1, -1, -1):
        below = tops.where(F.col("depth") == depth + 1).drop("depth")
        if done:
            below = below.unionAll(done[-1].select(F.col("parent_conv_id").alias("parent"), "n_leaves", "saved_tokens"))
        sums = below.groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
        here = shared[depth].join(sums, "node", "left").join(ended.where(F.col("depth") == depth).drop("depth"), "node", "left")
        zero = F.lit(0).cast("long")
        done.append(settled(here.select(
            F.col("node").alias("conv_id"), F.lit(depth).cast("long").alias("depth"), F.col("parent").alias("parent_conv_id"), "n_convs", F.coalesce("n_children", zero).alias("n_children"), F.coalesce("leaves", F.lit(1)).cast("long").alias("n_leaves"),
            (F.coalesce("saved", zero) + (F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(NONE)).alias("ends_sha256"),
        )))
    return reduce(DataFrame.unionAll, done, single.select(*NODE))
