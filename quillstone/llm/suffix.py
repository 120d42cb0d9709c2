"""Removal of long repeated strings by suffix sorting in blocks, with a difference cover.

Every string of `LENGTH` bytes has one anchor: the place of its smallest `GRAM`-byte fingerprint
(the leftmost of equal ones). Equal strings have equal anchors at equal distances, so the strings
that start around one kind of anchor form a bucket of suffixes that no other bucket can match, and
only buckets with two places or more are looked at. A place's neighbourhood holds all strings that
its anchor serves; equal neighbourhoods are one, and one with two places is repeated as a whole.

The suffixes of the other neighbourhoods are sorted bucket by bucket: first by their first bytes,
then, where these tie, by the ranks of the block's cover sample. Columns count from the anchor;
those whose remainder is in a difference cover are ranked once a block, so a tie is settled by the
rank at the next sampled column and the bytes of the end, and memory is bounded by the block. Buckets
of more neighbourhoods than a block are cut; their strings meet again by fingerprints.

Fingerprints of neighbourhoods have 64 bits, those of anchors 48; anchors that agree by chance share a bucket. Defined results: texts are UTF-8 bytes,
null is empty; texts shorter than `LENGTH` keep all; overlaps within a text count; equal rows are
places of their own; rows with equal ids but other texts are separate.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _grams as G
from ._tables import written

LENGTH, GRAM = 200, 32
LEFT = LENGTH - GRAM  # an anchor is at most so far behind the start of its string
COVER = 32
BLOCK = 4096
PLACE = 31  # bits of a place in the key that is minimised
WIDTH = LEFT + LENGTH
SHORTER = 16  # bits that an anchor's number drops: it only names a bucket, in which all bytes are compared


def cover(modulus: int = COVER) -> tuple[int, ...]:
    """A small set of remainders whose differences are all remainders, grown greedily."""
    found: list[int] = [0]
    missing = set(range(1, modulus))
    while missing:
        gain = lambda x: len(missing & {d for y in found for d in ((x - y) % modulus, (y - x) % modulus)})
        best = max(range(modulus), key=lambda x: (gain(x), -x))
        missing -= {d for y in found for d in ((best - y) % modulus, (y - best) % modulus)}
        found.append(best)
    return tuple(sorted(found))


_COVER = cover()
#: For each column the distance to the next sampled one.
NEXT = np.array([min((x - c) % COVER for x in _COVER) for c in range(WIDTH)])


def anchors(texts: G.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor fingerprints, their places, and the first and last start of the strings that they serve."""
    n, none = len(texts.data), np.zeros(0, np.int64)
    sizes = np.diff(texts.offs)
    if n < LENGTH or sizes.max(initial=0) < LENGTH:
        return none.astype(G.U), none, none, none
    prints = G.windows_of_32(texts.data)
    keys = (prints >> G.U(PLACE)) << G.U(PLACE) | np.arange(len(prints), dtype=G.U)
    # a string never passes its text's end, so grams that do are never its smallest; sliding minima by blocks
    span = LEFT + 1
    rows = -(-len(keys) // span)
    padded = np.full(rows * span, np.iinfo(G.U).max, G.U)
    padded[: len(keys)] = keys
    grid = padded.reshape(rows, span)
    ahead = np.minimum.accumulate(grid, 1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
    firsts = n - LENGTH + 1
    least = np.minimum(behind[:firsts], ahead[LEFT : LEFT + firsts])
    inside = np.zeros(n + 1, np.int8)
    long = sizes >= LENGTH
    inside[texts.offs[:-1][long]] = 1
    inside[texts.offs[1:][long] - LENGTH + 1] -= 1
    valid = np.flatnonzero(np.cumsum(inside[:firsts]))
    place = (least[valid] & G.U((1 << PLACE) - 1)).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    last = valid[np.append(new[1:], len(valid)) - 1]
    return prints[place[new]] >> G.U(SHORTER), place[new], valid[new], last


#: `extent` is the lead (bytes before the anchor) in the upper half and the span (bytes in all) in the lower.
FOUND = "anchor long, context long, row long, check int, place int, extent int"
LEAD, SPAN = "shiftright(extent, 16)", "extent & 65535"


def places(documents: DataFrame) -> DataFrame:
    """`FOUND` for every anchor of the rows (row, check, text): its neighbourhood's fingerprint, and where that is in the text."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in G.batches(frames):
            prints, place, first, last = anchors(texts)
            if not len(prints):
                continue
            owner = np.searchsorted(texts.offs, place, side="right") - 1
            lead = place - first
            whole = texts.hashes(first, last + LENGTH)
            context = G.mix(whole ^ prints * G.U(0x9E3779B97F4A7C15) + lead.astype(G.U))
            row, check = (part.column(k).to_numpy()[owner] for k in (0, 1))
            extent = (lead << 16 | last + LENGTH - first).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(prints.view(np.int64)), pa.array(context.view(np.int64)), pa.array(row), pa.array(check), pa.array((first - texts.offs[owner]).astype(np.int32)), pa.array(extent)], [c.split()[0] for c in FOUND.split(", ")])

    return documents.select("row", "check", "text").mapInArrow(run, FOUND)


def count_anchors(documents: DataFrame) -> DataFrame:
    """anchor, n: how often each anchor fingerprint occurs, summed within tasks first."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in G.batches(frames):
            every, n = np.unique(anchors(texts)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(every.view(np.int64)), pa.array(n)], ["anchor", "n"])

    return documents.select("text").mapInArrow(run, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))


def cut(rows: DataFrame) -> DataFrame:
    """anchor, context, block, blocks, lead, piece, from rows (row, check, text, wanted): the bytes of the wanted neighbourhoods.

    Of rows that are repeated a task cuts one.
    """
    shape = "anchor long, context long, block int, blocks int, lead int, piece binary"

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("anchor", "context", "block", "blocks", "lead")
        seen: set[tuple] = set()
        for frame in frames:
            for i, known in enumerate(zip(frame.column(0).to_pylist(), frame.column(1).to_pylist(), strict=True)):
                if known in seen:
                    continue
                seen.add(known)
                text = (frame.column(2)[i].as_py() or "").encode()
                wanted = frame.column(3)[i].values
                place, span = wanted.field("place").to_pylist(), wanted.field("span").to_pylist()
                yield pa.RecordBatch.from_arrays([*(wanted.field(k) for k in names), pa.array([text[a : a + b] for a, b in zip(place, span, strict=True)], pa.binary())], [*names, "piece"])

    return rows.select("row", "check", "text", "wanted").mapInArrow(run, shape)


def sort_block(bucket: np.ndarray, leads: np.ndarray, pieces: list[bytes]) -> np.ndarray:
    """Whether each string of each neighbourhood has an equal one in its bucket.

    The result has a row for each neighbourhood and a column for each start, counted from `LEFT`
    before the anchor. Suffixes of one column are sorted at a time.
    """
    m = len(pieces)
    text = np.zeros((m, WIDTH), np.uint8)
    for i, (lead, piece) in enumerate(zip(leads.tolist(), pieces, strict=True)):
        text[i, LEFT - lead : LEFT - lead + len(piece)] = np.frombuffer(piece, np.uint8)
    words = np.zeros((m, WIDTH - 7), G.U)
    for k in range(8):
        words = (words << G.U(8)) | text[:, k : WIDTH - 7 + k]
    words = np.ascontiguousarray(words.T)
    first = LEFT - leads
    last = first + np.array([len(p) for p in pieces]) - LENGTH
    twice = np.zeros((m, LEFT + 1), bool)
    ranks: dict[int, np.ndarray] = {}
    for column in range(LEFT + 1):
        rows = np.flatnonzero((first <= column) & (column <= last))
        if len(rows) < 2:
            continue
        keys = [bucket, *(words[column + k] for k in range(0, COVER, 8))]
        rows = rows[np.lexsort([k[rows] for k in keys[::-1]])]
        rows = _ties(rows, keys)
        if not len(rows):
            continue
        sample = column + int(NEXT[column])
        if sample not in ranks:
            ranks[sample] = _rank(words, sample)
        keys += [ranks[sample], *(words[column + k] for k in range(LENGTH - COVER, LENGTH, 8))]
        rows = rows[np.lexsort([k[rows] for k in keys[::-1]])]
        twice[_ties(rows, keys), column] = True
    return twice


def _ties(rows: np.ndarray, keys: list[np.ndarray]) -> np.ndarray:
    """Those of the sorted rows that equal a neighbour in all keys."""
    same = np.ones(len(rows) - 1, bool)
    for key in keys:
        same &= key[rows[1:]] == key[rows[:-1]]
    return rows[np.concatenate([[False], same]) | np.concatenate([same, [False]])]


def _rank(words: np.ndarray, column: int) -> np.ndarray:
    """Ranks of the rows by their LENGTH - COVER bytes from a sampled column."""
    keys = [words[column + k] for k in range(0, LENGTH - COVER, 8)]
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for key in keys:
        new[1:] |= key[order][1:] != key[order][:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


RESULT = "context long, runs array<struct<a:int,b:int>>, anchor long, column int, string long"


def sort_buckets(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """`RESULT` of rows of `cut` that are grouped by anchor and block; a neighbourhood that several tasks cut counts once.

    Either a neighbourhood's repeated bytes, as runs counted from its start; or, in a bucket that
    was cut, one fingerprint of each of its strings (with the context of one that isn't repeated here).
    """

    def flush(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        order = {key: i for i, key in enumerate(dict.fromkeys((r[0], r[2]) for r in held))}
        bucket = np.array([order[r[0], r[2]] for r in held])
        leads = np.array([r[4] for r in held])
        twice = sort_block(bucket, leads, [r[5] for r in held])
        out: list[tuple] = []
        for r, row in zip(held, twice, strict=True):
            starts = np.flatnonzero(row) - (LEFT - r[4])
            if len(starts):
                edge = np.flatnonzero(np.diff(starts) > LENGTH)
                out.append((r[1], [{"a": int(a), "b": int(b) + LENGTH} for a, b in zip(starts[np.append(0, edge + 1)], starts[np.append(edge, len(starts) - 1)], strict=True)], None, None, None))
            if r[3] > 1:
                had = set((starts + LEFT - r[4]).tolist())
                for k in range(len(r[5]) - LENGTH + 1):
                    column = k + LEFT - r[4]
                    print_ = int.from_bytes(hashlib.blake2b(r[5][k : k + LENGTH], digest_size=8).digest(), "little", signed=True)
                    out.append((None if column in had else r[1], None, r[0], column, print_))
        if out:
            shape = pa.schema([("context", pa.int64()), ("runs", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))), ("anchor", pa.int64()), ("column", pa.int32()), ("string", pa.int64())])
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], f.type) for i, f in enumerate(shape)], schema=shape)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        here: set[int] = set()  # neighbourhoods of the bucket's block that is being read
        for frame in frames:
            for row in zip(*(c.to_pylist() for c in frame.columns), strict=True):
                if held and (row[0], row[2]) != (held[-1][0], held[-1][2]):
                    here = set()
                    if len(held) >= block:
                        yield from flush(held)
                        held = []
                if row[1] not in here:
                    here.add(row[1])
                    held.append(row)
        if held:
            yield from flush(held)
        G.trim()

    return rows.mapInArrow(run, RESULT)


def removals(documents: DataFrame, block: int = BLOCK) -> DataFrame:
    """row, check, runs: the repeated bytes (from, to; perhaps overlapping) of the rows (row, check, text) that have some."""
    # written as Parquet, as checkpoints aren't compressed; and then a join's large partitions can be split
    often = written(count_anchors(documents).where("n > 1").select("anchor"))
    found = written(places(documents).join(often, "anchor"))
    contexts = written(found.groupBy("anchor", "context").agg(F.count("*").alias("n"), F.min(F.struct("row", "check", "place", "extent")).alias("one")))
    buckets = contexts.groupBy("anchor").agg(F.count("*").alias("m"), F.min("n").alias("least")).where("m > 1 AND least = 1").select("anchor", F.ceil(F.col("m") / block).cast("int").alias("blocks"))
    place = F.struct("anchor", "context", F.pmod(F.xxhash64("context"), F.col("blocks")).cast("int").alias("block"), "blocks", F.expr(LEAD).alias("lead"), "place", F.expr(SPAN).alias("span"))
    wanted = contexts.select("anchor", "context", "one.*").join(written(buckets), "anchor").select("row", "check", place.alias("w")).groupBy("row", "check").agg(F.collect_list("w").alias("wanted"))
    pieces = cut(documents.join(wanted, ["row", "check"]))
    sorted_ = written(sort_buckets(pieces.repartition("anchor", "block").sortWithinPartitions("anchor", "block"), block))
    strings = sorted_.where("string IS NOT NULL")
    twice = strings.groupBy("anchor", "column", "string").agg(F.count("*").alias("all")).where("all > 1").drop("all")
    known = contexts.select("context", "n", "one.extent").select("context", "n", F.expr(LEAD).alias("lead"), F.expr(SPAN).alias("span"))
    start = (F.col("column") - (LEFT - F.col("lead"))).cast("int")
    late = strings.where("context IS NOT NULL").join(twice, ["anchor", "column", "string"]).select("context", "column").join(known, "context")
    late = late.groupBy("context").agg(F.collect_set(F.struct(start.alias("a"), (start + LENGTH).alias("b"))).alias("runs"))
    whole = known.where("n > 1").select("context", F.array(F.struct(F.lit(0).alias("a"), F.col("span").alias("b"))).alias("runs"))
    parts = whole.unionAll(sorted_.where("runs IS NOT NULL").select("context", "runs")).unionAll(late)
    # the runs of one neighbourhood's starts; written, so that the join can split what many places have in common
    runs = written(parts.groupBy("context").agg(F.flatten(F.collect_list("runs")).alias("runs")))
    hits = found.join(runs, "context").select("row", "check", F.explode(F.transform("runs", lambda r: F.struct((F.col("place") + r["a"]).alias("a"), (F.col("place") + r["b"]).alias("b")))).alias("run"))
    return hits.groupBy("row", "check").agg(F.collect_set("run").alias("runs"))  # a set, so that repeated rows add nothing


def keyed(documents: DataFrame) -> DataFrame:
    """doc_id, row, check, text; row and check (96 bits of hashes) are equal for equal ids and texts only."""
    return documents.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), F.hash("text", "doc_id").alias("check"), "text")


def merged(runs: list[dict] | None) -> tuple[list[int], list[int]]:
    """Starts and ends of the maximal runs."""
    starts, ends = [], []
    for a, b in sorted((r["a"], r["b"]) for r in runs or ()):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def kept(text: bytes, starts: list[int], ends: list[int]) -> bytes:
    return b"".join(text[a:b] for a, b in zip([0, *ends], [*starts, len(text)], strict=True))


REPORT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def report(documents: DataFrame) -> DataFrame:
    """doc_id and `REPORT` of every document."""
    rows = keyed(documents)
    both = rows.join(removals(rows), ["row", "check"], "left").select("doc_id", "text", "runs")

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            out = []
            for text, runs in zip(frame.column(1), frame.column(2), strict=True):
                content = (text.as_py() or "").encode()
                starts, ends = merged(runs.as_py())
                out.append((len(content), sum(ends) - sum(starts), len(starts), hashlib.sha256(kept(content, starts, ends)).hexdigest()))
            yield pa.RecordBatch.from_arrays([frame.column(0), *(pa.array([o[i] for o in out], pa.string() if i == 3 else pa.int64()) for i in range(4))], ["doc_id", *(c.split()[0] for c in REPORT.split(", "))])

    return both.mapInArrow(run, f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, {REPORT}")


def strip(documents: DataFrame) -> DataFrame:
    """The documents, with repeated bytes removed from `text` (characters that are cut apart go too) and `n_chars` after that.

    Only texts that lose something go to Python; other columns stay on the JVM.
    """
    gone = removals(keyed(documents)).withColumnsRenamed({"row": "_one", "check": "_two", "runs": "_runs"})
    rows = documents.select(F.struct("*").alias("_row"), F.xxhash64("doc_id", "text").alias("_one"), F.hash("text", "doc_id").alias("_two"))

    @F.arrow_udf("string")
    def without(texts: pa.Array, runs: pa.Array) -> pa.Array:
        found = (None if text is None else kept(text.encode(), *merged(runs[i].as_py())).decode("utf-8", "ignore") for i, text in enumerate(x.as_py() for x in texts))
        return pa.array(found, pa.string())

    text = F.col("_row.text")
    left = F.coalesce(without(F.when(F.col("_runs").isNotNull(), text), F.col("_runs")), text)
    both = rows.join(gone, ["_one", "_two"], "left").select("_row", left.alias("_left"))
    new = {"text": F.col("_left")} | ({"n_chars": F.length("_left").cast("long")} if "n_chars" in documents.columns else {})
    return both.select(*(new.get(c, F.col(f"_row.{c}")).alias(c) for c in documents.columns))
