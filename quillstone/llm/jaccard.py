"""N-gram Jaccard join with Bayesian pruning of MinHash candidates.

Texts are sets of word shingles; texts with equal sets are one node. Nodes that agree in a band
of MinHash values are candidates. A candidate pair's MinHash values are compared a few at a time,
and the pair is dropped as soon as the posterior probability that its similarity reaches the
threshold falls below a tolerance; all other pairs are verified exactly on their whole sets.

No pair of a group is ever a row: each bucket has a leader (its smallest node), nodes meet at
their few leaders, large meetings are cut into blocks, and a task returns for each node of its
block pair the number of linked documents and one edge. A pair is only counted at the leader of
the first band that it shares.

Defined results: words are `[^\\x20\\x09-\\x0D]+`; a text of fewer words than a shingle has one
shingle of all its words; all texts without a word (null too) are one class; every row is a
document of its own, whether its id is null, repeated or unique: repeated rows are copies of each
other, and rows with equal ids but other texts are compared like any others; a class whose ids are
all null has the class id null.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _grams as G
from ._groups import tell
from ._tables import settled
from .components import components

WORDS, THRESHOLD = 5, 0.8
BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
#: MinHash values compared at a time, and the posterior probability below which a pair is dropped.
STEP, TOLERANCE = 16, 1e-7
#: Nodes of a block; a task holds two blocks at most.
BLOCK = 512
_random = np.random.default_rng(20_240_229)
_FLIP = _random.integers(0, 1 << 32, HASHES, np.uint32)
_TIMES = _random.integers(0, 1 << 31, HASHES, np.uint32) * np.uint32(2) + np.uint32(1)


def least_matches(n: int, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> int:
    """The fewest matches in n MinHash values that keep a pair.

    With a uniform prior the posterior of the similarity is Beta(m + 1, n - m + 1), whose mass
    above t is the probability that a Binomial(n + 1, t) is at most m.
    """
    below = 0.0
    for m in range(n + 1):
        below += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if below >= tolerance:
            return m
    return n + 1


def minhash(shingles: np.ndarray) -> np.ndarray:
    """The `HASHES` smallest values of a set's shingles (at least one) under as many hashings."""
    low = (shingles >> G.U(32)).astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(low), 4096):
        part = low[i : i + 4096]
        np.minimum(out, ((part[None, :] ^ _FLIP[:, None]) * _TIMES[:, None]).min(1), out=out)
    return out


def sets(texts: G.Texts) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each text."""
    starts, ends, offs = texts.words()
    grams, at = G.shingles(texts.hashes(starts, ends), offs, WORDS)
    for i in range(texts.n):
        yield np.unique(grams[at[i] : at[i + 1]])


def node_of(shingles: np.ndarray) -> int:
    """A 64-bit fingerprint of a set."""
    with np.errstate(over="ignore"):
        total = G.mix(shingles ^ G.U(0x5851F42D4C957F2D)).sum(dtype=G.U)
        return int(G.mix(np.array([total + G.U(len(shingles)) * G.U(0x9E3779B97F4A7C15)], G.U)).astype(np.int64)[0])


def bands_of(signature: np.ndarray) -> np.ndarray:
    h = np.arange(BANDS, dtype=G.U) + G.U(1)
    for column in signature.reshape(BANDS, ROWS).T:
        h = G.mix(h * G.U(0x9E3779B97F4A7C15) ^ column)
    return h.astype(np.int64)


def keyed(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, _key, text: rows with equal ids and texts have equal keys."""
    return documents.select(F.col(key).alias("doc_id"), F.xxhash64(key, text).alias("_key"), F.col(text).alias("text"))


def signatures(rows: DataFrame) -> DataFrame:
    """doc_id, _key, node, bands (none for a text without a word) of the rows of `keyed`."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in G.batches(frames):
            nodes, bands = [], []
            for s in sets(texts):
                nodes.append(node_of(s))
                bands.append(bands_of(minhash(s)) if len(s) else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(nodes, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "_key", "node", "bands"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, _key long, node long, bands array<long>")


def payloads(candidates: DataFrame) -> DataFrame:
    """node, copies, leads, times, signature, shingles, from node, copies, leads, times, text; a text of another node is dropped."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in G.batches(frames):
            nodes = part.column(0).to_pylist()
            found = [(i, s) for i, s in enumerate(sets(texts)) if len(s) and node_of(s) == nodes[i]]
            kept = part.take(pa.array([i for i, _ in found], pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns[:4], pa.array([minhash(s).tobytes() for _, s in found], pa.binary()), pa.array([s.tobytes() for _, s in found], pa.binary())], ["node", "copies", "leads", "times", "signature", "shingles"])

    return candidates.select("node", "copies", "leads", "times", "text").mapInArrow(run, "node long, copies long, leads array<struct<band:int,leader:long>>, times long, signature binary, shingles binary")


def compare(nodes: np.ndarray, copies: np.ndarray, leads: np.ndarray, signature: np.ndarray, shingles: list[np.ndarray], leader: int, sides: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(linked documents, smallest node of the piece) of each node of one meeting.

    Pairs are taken within all nodes, or between two sides; row by row, so memory is bounded.
    """
    n = len(nodes)
    sizes = np.array([len(s) for s in shingles])
    kept: list[np.ndarray] = []
    left, right = sides if sides is not None else (np.arange(n), None)
    needs = [(m, least_matches(m)) for m in range(STEP, HASHES + 1, STEP)]
    for at in range(0, len(left), 256):
        rows = left[at : at + 256]
        others = right if right is not None else np.arange(n)
        a, b = (x.ravel() for x in np.meshgrid(rows, others, indexing="ij"))
        if right is None:
            a, b = a[a < b], b[a < b]
        possible = np.minimum(sizes[a], sizes[b]) >= THRESHOLD * np.maximum(sizes[a], sizes[b])
        a, b = a[possible], b[possible]
        shared = leads[a] == leads[b]
        first = shared.argmax(1)
        here = shared[np.arange(len(a)), first] & (leads[a, first] == leader)
        a, b = a[here], b[here]
        matches = np.zeros(len(a), np.int64)
        for upto, need in needs:
            matches += (signature[a, upto - STEP : upto] == signature[b, upto - STEP : upto]).sum(1)
            alive = matches >= need
            a, b, matches = a[alive], b[alive], matches[alive]
        if len(a):
            kept.append(np.stack([a, b]))
    if not kept:
        return np.zeros(n, np.int64), nodes
    a, b = np.concatenate(kept, 1)
    inter = overlaps(shingles, a, b)
    linked = inter >= THRESHOLD * (sizes[a] + sizes[b] - inter) - 1e-9
    a, b = a[linked], b[linked]
    links = np.bincount(a, copies[b], n) + np.bincount(b, copies[a], n)
    root = np.arange(n)
    while True:  # the smallest place that is reached, with pointers halved
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return links.astype(np.int64), nodes[root]
        root = new


def overlaps(shingles: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The number of common shingles of each pair."""
    n = len(shingles)
    if len(a) <= 8 * n:
        return np.array([np.intersect1d(shingles[i], shingles[j], assume_unique=True).size for i, j in zip(a, b, strict=True)], np.int64)
    every, where, counts = np.unique(np.concatenate(shingles), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), [len(s) for s in shingles])
    often = counts[where] > 1
    owner, where = owner[often], (np.cumsum(counts > 1) - 1)[where[often]]
    order = np.argsort(where, kind="stable")
    owner, where = owner[order], where[order]
    common = np.zeros((n, n), np.float32)
    for low in range(0, int(where[-1]) + 1 if len(where) else 0, 2048):
        i, j = np.searchsorted(where, [low, low + 2048])
        block = np.zeros((n, 2048), np.float32)
        block[owner[i:j], where[i:j] - low] = 1
        common += block @ block.T
    return common[a, b].astype(np.int64)


def meetings(cells: DataFrame) -> DataFrame:
    """node, other, links, of rows (leader, i, j, side, payload) that are grouped and sorted by leader, i, j."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for frame in frames:
            for row in frame.to_pylist():
                if held and (row["leader"], row["i"], row["j"]) != (held[0]["leader"], held[0]["i"], held[0]["j"]):
                    yield from meet(held)
                    held = []
                held.append(row)
        if held:
            yield from meet(held)
        G.trim()

    return cells.mapInArrow(run, "node long, other long, links long")


def meet(rows: list[dict]) -> Iterator[pa.RecordBatch]:
    if len(rows) < 2:
        return
    rows = sorted(rows, key=lambda r: r["node"])
    nodes = np.array([r["node"] for r in rows], np.int64)
    leads = np.repeat(nodes[:, None], BANDS, 1)
    for at, r in enumerate(rows):
        for lead in r["leads"]:
            leads[at, lead["band"]] = lead["leader"]
    side = np.array([r["side"] for r in rows])
    cross = rows[0]["i"] != rows[0]["j"]
    signature = np.frombuffer(b"".join(r["signature"] for r in rows), np.uint32).reshape(-1, HASHES)
    links, other = compare(nodes, np.array([r["copies"] for r in rows], np.int64), leads, signature, [np.frombuffer(r["shingles"], G.U) for r in rows], rows[0]["leader"], (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if cross else None)
    found = links > 0
    if found.any():
        yield pa.RecordBatch.from_arrays([pa.array(nodes[found]), pa.array(other[found]), pa.array(links[found])], ["node", "other", "links"])


def links(rows: DataFrame, marked: DataFrame, block: int = BLOCK) -> DataFrame:
    """node, other, links: partial counts of linked documents and spanning edges, of the nodes of `signatures`.

    A node's text is that of the row of its smallest key; where that row is repeated, one is taken.
    """
    nodes = settled(marked.groupBy("node").agg(F.min("_key").alias("_key"), F.count("*").alias("copies"), F.first("bands").alias("bands")))
    spread = nodes.select("node", F.posexplode("bands").alias("band", "bucket"))
    leaders = spread.groupBy("bucket").agg(F.min("node").alias("leader"), F.count("*").alias("n")).where("n > 1").drop("n")
    met = spread.join(leaders, "bucket").groupBy("node").agg(F.collect_list(F.struct("band", "leader")).alias("leads"))
    candidates = settled(nodes.join(met, "node").select("node", "_key", "copies", "leads"))
    times = marked.select("_key").join(candidates.where("copies > 1").select("_key"), "_key").groupBy("_key").agg(F.count("*").alias("times"))
    candidates = candidates.join(times, "_key", "left").withColumn("times", F.coalesce("times", F.lit(1)).cast("long"))
    held = settled(payloads(rows.select("_key", "text").join(candidates, "_key")))
    one = ("copies", "leads", "times", "signature", "shingles")
    held = held.where("times = 1").unionByName(held.where("times > 1").groupBy("node").agg(*(F.first(c).alias(c) for c in one)))
    # who meets where is settled without the sets, which are joined last, by node: a leader of most nodes is told in parts
    at = candidates.select("node", F.explode(F.array_distinct("leads.leader")).alias("leader"))
    counted = tell(at, ["leader"], {"n": F.count("*")}, "node").where("n > 1").withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    cells = counted.withColumn("own", own).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = cells.select("leader", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), (F.col("own") > F.col("with")).cast("int").alias("side"), "node")
    cells = cells.join(held.select("node", "copies", "leads", "signature", "shingles"), "node").select("leader", "i", "j", "side", "node", "copies", "leads", "signature", "shingles")
    return settled(meetings(cells.repartition("leader", "i", "j").sortWithinPartitions("leader", "i", "j")))


def classes(documents: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, _key, class_id, n_links, head of every row: its class's smallest id, and the key of the class's row to keep."""
    rows = keyed(documents)
    marked = settled(signatures(rows))
    found = links(rows, marked, block)
    counted = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("node").alias("a"), F.col("other").alias("b")))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "_key"))
    nodes = marked.groupBy("node").agg(first.alias("least"), F.count("*").alias("copies"))
    nodes = nodes.join(counted, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    heads = nodes.groupBy("root").agg(F.min("least").alias("least"))
    answers = nodes.drop("least").join(heads, "root").select("node", F.col("least.doc_id").alias("class_id"), F.col("least._key").alias("head"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    return marked.select("doc_id", "_key", "node").join(answers, "node").select("doc_id", "_key", "class_id", "n_links", "head")


def join(documents: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, class_id (the smallest id of the class), n_links (other documents at the threshold or above) of every row."""
    return classes(documents, block).select("doc_id", "class_id", "n_links")


def keep_one(documents: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row of each class: that of its smallest id (without any id: of the smallest key), and one of equal rows."""
    heads = classes(documents, block).where("_key = head").groupBy("_key").agg(F.count("*").alias("_times"))
    rows = documents.select(F.struct("*").alias("_row"), F.xxhash64("doc_id", "text").alias("_key")).join(heads, "_key")
    others = [F.col(f"_row.{f.name}") for f in documents.schema if f.name not in ("doc_id", "text") and not isinstance(f.dataType, (T.MapType, T.VariantType))]
    repeated = rows.where("_times > 1").withColumn("_n", F.row_number().over(Window.partitionBy("_row.doc_id", "_row.text").orderBy("_key", *others)))
    return rows.where("_times = 1").select("_row.*").unionAll(repeated.where("_n = 1").select("_row.*"))
