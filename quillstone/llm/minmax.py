"""MinHash near-dedup with min-max hashing: each permutation gives its smallest and its largest value.

Texts are sets of shingles of two words, without regard to case (A-Z); texts with equal sets are
one node. `PERMUTATIONS` hashings give twice as many signature values. Bands of four smallest or
of four largest values deal the nodes into buckets; a pair at the threshold shares none of the 32
with a probability below 5e-8 (a smallest and a largest value are never the same odd shingle, so
the two kinds of bands fail together less often than independent ones).

Only reachability is asked for, so no pair of a group is ever a row. Every node of a bucket is
first compared with the bucket's leader (its smallest node), on whole sets, in cells that repeat
the leader's set. Where the nodes of a leader are one component after that, nothing is left to do.
Where they aren't, blocks of them meet, those of one component never with each other: within a
meeting, pairs of unlike components whose signatures don't rule them out are compared on whole
sets, and only edges that join components leave the task.

Defined results: words are `[^\\x20\\x09-\\x0D]+`; a text of one word has one shingle, that word; a
text without a word (null too) has none and is linked with nothing, so its component is its own
id; every row is a document of its own: repeated rows and rows with equal ids are copies or not by
their texts alone; a component's id is its smallest id that isn't null (null if there is none),
and `kept` compares it with the row's own; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _grams as G
from ._groups import tell
from ._tables import settled, written
from .components import components
from .jaccard import keyed, least_matches, node_of, overlaps

WORDS, PERCENT = 2, 80
PERMUTATIONS, ROWS = 64, 4
BANDS = 2 * PERMUTATIONS // ROWS
#: Nodes of a cell or block.
BLOCK = 256
#: Parts of a group that meet their group's answer separately.
SALTS = 64
_random = np.random.default_rng(20_240_601)
_FLIP = _random.integers(0, 1 << 32, PERMUTATIONS, np.uint32)
_TIMES = _random.integers(0, 1 << 31, PERMUTATIONS, np.uint32) * np.uint32(2) + np.uint32(1)


def sets(texts: G.Texts) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each text, its letters A-Z in lower case."""
    upper = (texts.data >= 65) & (texts.data <= 90)
    low = G.Texts(np.where(upper, texts.data | np.uint8(32), texts.data), texts.offs)
    starts, ends, offs = low.words()
    grams, at = G.shingles(low.hashes(starts, ends), offs, WORDS)
    for i in range(low.n):
        yield np.unique(grams[at[i] : at[i + 1]])


def signature(shingles: np.ndarray) -> np.ndarray:
    """The smallest values of a set (at least one shingle) under each hashing, then the largest."""
    part_of = (shingles >> G.U(32)).astype(np.uint32)
    low, high = np.full(PERMUTATIONS, 0xFFFFFFFF, np.uint32), np.zeros(PERMUTATIONS, np.uint32)
    for i in range(0, len(part_of), 4096):
        hashed = (part_of[None, i : i + 4096] ^ _FLIP[:, None]) * _TIMES[:, None]
        np.minimum(low, hashed.min(1), out=low)
        np.maximum(high, hashed.max(1), out=high)
    return np.concatenate([low, high])


def bands_of(values: np.ndarray) -> np.ndarray:
    """A bucket for each band; the first half are bands of smallest values, the second of largest."""
    h = np.arange(BANDS, dtype=G.U) + G.U(1)
    for column in values.reshape(BANDS, ROWS).T:
        h = G.mix(h * G.U(0x9E3779B97F4A7C15) ^ column)
    return h.astype(np.int64)


def signatures(rows: DataFrame) -> DataFrame:
    """doc_id, _key, node, n_shingles, bands (none for a text without a word) of the rows of `keyed`."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in G.batches(frames):
            nodes, sizes, bands = [], [], []
            for s in sets(texts):
                nodes.append(node_of(s))
                sizes.append(len(s))
                bands.append(bands_of(signature(s)) if len(s) else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "_key", "node", "n_shingles", "bands"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, _key long, node long, n_shingles long, bands array<long>")


def payloads(candidates: DataFrame) -> DataFrame:
    """node, values, shingles from node, text; a text of another node is dropped."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in G.batches(frames):
            nodes = part.column(0).to_pylist()
            found = [(node, s) for node, s in zip(nodes, sets(texts), strict=True) if len(s) and node_of(s) == node]
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in found], pa.int64()), pa.array([signature(s).tobytes() for _, s in found], pa.binary()), pa.array([s.tobytes() for _, s in found], pa.binary())], ["node", "values", "shingles"])

    return candidates.select("node", "text").mapInArrow(run, "node long, values binary, shingles binary")


def near(inter: np.ndarray | int, a: np.ndarray | int, b: np.ndarray | int) -> np.ndarray | bool:
    return 100 * inter >= PERCENT * (a + b - inter)


EDGES = "a long, b long"


def _edges(a: list[int], b: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def stars(cells: DataFrame) -> DataFrame:
    """`EDGES` between a leader and the nodes that reach the threshold with it.

    Of rows (leader, cell, follows, node, shingles), grouped and sorted by the first three: a
    cell's first row is its leader. One row of a cell is held at a time besides the leader.
    """

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, lead = None, np.zeros(0, G.U)
        for frame in frames:
            leader, number, follows, node = (frame.column(k).to_pylist() for k in range(4))
            a, b = [], []
            for k, raw in enumerate(frame.column(4)):
                shingles = np.frombuffer(raw.as_py(), G.U)
                if not follows[k]:
                    cell, lead = (leader[k], number[k]), shingles
                elif cell == (leader[k], number[k]):
                    at = np.searchsorted(lead, shingles)
                    inter = int((lead[np.minimum(at, len(lead) - 1)] == shingles).sum())
                    if near(inter, len(lead), len(shingles)):
                        a.append(node[k])
                        b.append(leader[k])
            yield _edges(a, b)
        G.trim()

    return cells.mapInArrow(run, EDGES)


def joined(roots: np.ndarray, sides: np.ndarray | None, values: np.ndarray, shingles: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Places of a meeting's nodes that are linked though of unlike roots: a spanning set of links.

    Pairs are looked at by rows of 64; those that earlier links have joined are left out.
    """
    sizes, need = np.array([len(s) for s in shingles]), least_matches(2 * PERMUTATIONS, PERCENT / 100)
    _, label = np.unique(roots, return_inverse=True)
    left = np.flatnonzero(sides == 0) if sides is not None else np.arange(len(roots))
    right = np.flatnonzero(sides == 1) if sides is not None else np.arange(len(roots))
    from_, to = [], []
    for k in range(0, len(left), 64):
        a, b = (x.ravel() for x in np.meshgrid(left[k : k + 64], right, indexing="ij"))
        wanted = (label[a] != label[b]) & (100 * np.minimum(sizes[a], sizes[b]) >= PERCENT * np.maximum(sizes[a], sizes[b]))
        if sides is None:
            wanted &= a < b
        a, b = a[wanted], b[wanted]
        alike = np.concatenate([(values[a[i : i + 4096]] == values[b[i : i + 4096]]).sum(1) for i in range(0, len(a), 4096)]) if len(a) else np.zeros(0)
        a, b = a[alike >= need], b[alike >= need]
        if len(a):
            linked = near(overlaps(shingles, a, b), sizes[a], sizes[b])
            for x, y in zip(a[linked].tolist(), b[linked].tolist(), strict=True):
                if label[x] != label[y]:
                    from_.append(x)
                    to.append(y)
                    label[label == label[y]] = label[x]
    return np.array(from_, np.int64), np.array(to, np.int64)


def meetings(rows: DataFrame) -> DataFrame:
    """`EDGES` that join unlike roots, of rows (i, j, side, node, root, values, shingles) grouped and sorted by i, j."""

    def meet(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        nodes, roots = (np.array([r[k] for r in held], np.int64) for k in (3, 4))
        sides = np.array([r[2] for r in held]) if held[0][0] != held[0][1] else None
        values = np.frombuffer(b"".join(r[5] for r in held), np.uint32).reshape(len(held), -1)
        x, y = joined(roots, sides, values, [np.frombuffer(r[6], G.U) for r in held])
        yield _edges(nodes[x].tolist(), nodes[y].tolist())

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for frame in frames:
            for row in zip(*(c.to_pylist() for c in frame.columns), strict=True):
                if held and row[:2] != held[0][:2]:
                    yield from meet(held)
                    held = []
                held.append(row)
        if held:
            yield from meet(held)
        G.trim()

    return rows.mapInArrow(run, EDGES)


def first_look(pairs: DataFrame, held: DataFrame, block: int) -> DataFrame:
    """`EDGES` of pairs (node, leader)."""
    sizes = written(pairs.groupBy("leader").agg(F.ceil(F.count("*") / block).cast("int").alias("cells")))
    follow = pairs.join(sizes, "leader").select("leader", F.pmod(F.xxhash64("node"), F.col("cells")).cast("int").alias("cell"), F.lit(1).alias("follows"), "node")
    lead = sizes.select("leader", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("cell"), F.lit(0).alias("follows"), F.col("leader").alias("node"))
    cells = follow.unionAll(lead).join(held.drop("values"), "node").select("leader", "cell", "follows", "node", "shingles")
    return settled(stars(cells.repartition("leader", "cell").sortWithinPartitions("leader", "cell", "follows")))


def second_look(pairs: DataFrame, edges: DataFrame, held: DataFrame, block: int) -> DataFrame:
    """`EDGES` between nodes of one leader that the edges leave in unlike components."""
    roots = components(edges)
    known = pairs.join(roots, "node", "left").select("leader", "node", F.coalesce("root", "node").alias("root"))
    split = known.groupBy("leader").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most").select("leader")
    known = written(known.join(written(split), "leader"))
    if known.isEmpty():
        return edges.where("false")
    classes = known.groupBy("leader", "root").agg(F.count("*").alias("m"))
    large = written(classes.where(F.col("m") >= block).select("leader", "root", F.ceil(F.col("m") / block).cast("int").alias("cells")))
    few = written(classes.where(F.col("m") < block).groupBy("leader").agg(F.ceil(F.sum("m") / block).cast("int").alias("mixed")))
    marked = known.join(large, ["leader", "root"], "left").join(few, "leader", "left")
    pure = F.col("cells").isNotNull()
    number = F.pmod(F.xxhash64(F.lit(3), F.col("node")), F.coalesce("cells", "mixed")).cast("int")
    label = F.when(pure, F.col("root"))
    rows = marked.select("leader", "node", "root", F.xxhash64("leader", pure, label, number).alias("block"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias("number")
    blocks = large.select("leader", F.lit(True).alias("pure"), F.col("root").alias("label"), every("cells")).unionAll(few.select("leader", F.lit(False), F.lit(None).cast("long"), every("mixed")))
    blocks = blocks.select("leader", "pure", "label", F.xxhash64("leader", "pure", "label", "number").alias("block"))
    a, b = (blocks.select("leader", *(F.col(c).alias(f"{c}{k}") for c in ("pure", "label", "block"))) for k in (1, 2))
    apart = (F.col("block1") < F.col("block2")) & ~(F.col("pure1") & F.col("pure2") & F.col("label1").eqNullSafe(F.col("label2")))
    met = written(a.join(b, "leader").where(apart | ((F.col("block1") == F.col("block2")) & ~F.col("pure1"))).select(F.col("block1").alias("i"), F.col("block2").alias("j")))
    ends = met.select("i", "j", F.col("i").alias("block"), F.lit(0).alias("side")).unionAll(met.where("i <> j").select("i", "j", "j", F.lit(1)))
    dealt = rows.join(ends, "block").join(held, "node").select("i", "j", "side", "node", "root", "values", "shingles")
    return settled(meetings(dealt.repartition("i", "j").sortWithinPartitions("i", "j")))


def links(rows: DataFrame, nodes: DataFrame, block: int = BLOCK) -> DataFrame:
    """`EDGES` whose components are those of all links between the nodes (node, _key, times, bands).

    A node's text is that of the row of its smallest key; where that row is repeated, one is taken.
    """
    spread = nodes.select("node", F.explode("bands").alias("bucket"))
    leaders = spread.groupBy("bucket").agg(F.min("node").alias("leader"), F.count("*").alias("n")).where("n > 1").drop("n")
    pairs = settled(spread.join(leaders, "bucket").where("node <> leader").select("node", "leader").distinct())
    taking = pairs.select("node").unionAll(pairs.select(F.col("leader").alias("node"))).distinct()
    texts = nodes.select("node", "_key", "times").join(taking, "node").join(rows.select("_key", "text"), "_key")
    once, often = payloads(texts.where("times = 1")), payloads(texts.where("times > 1"))
    held = written(once.unionAll(often.groupBy("node").agg(F.first("values").alias("values"), F.first("shingles").alias("shingles"))))
    edges = first_look(pairs, held, block)
    return edges.unionAll(second_look(pairs, edges, held, block))


def near_dedup(documents: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    rows = keyed(documents)
    marked = settled(signatures(rows).withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")))
    # two steps, so that the rows of one set don't meet in one task
    some = marked.where("n_shingles > 0")
    parts = settled(some.groupBy("node", "salt").agg(F.min("doc_id").alias("least"), F.min("_key").alias("_key"), F.first("bands").alias("bands")))
    nodes = parts.groupBy("node").agg(F.min("least").alias("least"), F.min("_key").alias("_key"), F.first("bands").alias("bands"))
    times = some.groupBy("_key").agg(F.count("*").alias("times")).where("times > 1")
    nodes = settled(nodes.join(times, "_key", "left").withColumn("times", F.coalesce("times", F.lit(1))))
    roots = components(links(rows, nodes, block))
    placed = nodes.select("node", F.col("least").alias("own")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    placed = tell(placed, ["root"], {"least": F.min("own")}, "node").select("node", F.col("least").alias("component_id"))
    answers = parts.select("node", "salt").join(placed, "node")
    found = some.select("doc_id", "n_shingles", "node", "salt").join(answers, ["node", "salt"]).select("doc_id", "n_shingles", "component_id")
    alone = marked.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return found.unionAll(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
