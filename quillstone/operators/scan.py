"""The nearest rows of a batch of queries by matrix products, each task on its own rows.

A task takes its rows in runs, multiplies a run's vectors with those of some queries at a time, and
looks only at the pairs whose product comes near a query's k-th best so far. These are measured
again term by term, in the order of the components, so that distances are those of a plain sum and
don't depend on how a product was blocked. At most k rows a query leave each run; a window over
what the tasks leave settles the rest.

Defined results: distances are ordered by their rounded value, then by id; numbers come before NaN,
and both before what can't be measured (a missing vector, one of another length or with a missing
component), whose distance is null. Queries are held in blocks whose components and results are
bounded; blocks beyond the first are scanned one after another and written.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import written

#: Components of a run's rows, pairs that are multiplied and pairs that are measured at a time, at most.
RUN, TILE, MEASURED = 1 << 21, 1 << 22, 1 << 16
#: Components of a block's queries and results that a block's queries have together, at most.
HELD = 1 << 22
ORDER_DIGITS = 9
#: What rounding may take from a product, as a share of the vectors' lengths.
SLACK = 1e-11


@dataclass(frozen=True)
class Asked:
    """Queries of a block: ids, vectors, which have none, and the cells that each may look at (all, if none are given)."""

    ids: pa.Array
    points: np.ndarray
    absent: np.ndarray
    probes: np.ndarray | None = None


def matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(vectors as rows, which of them are missing): a missing one is a row of NaN."""
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    there = lengths == width
    own = column if there.all() else column.filter(pa.array(there))
    out = np.full((len(column), width), np.nan)
    flat = own.flatten()
    out[there] = np.asarray(flat.to_numpy(zero_copy_only=False), np.float64).reshape(-1, width)
    absent = ~there
    if flat.null_count:
        broken = np.zeros(len(own), bool)
        broken[np.flatnonzero(np.asarray(flat.is_null())) // max(width, 1)] = True
        absent[there] = broken
        out[absent] = np.nan
    return out, absent


def rounded(values: np.ndarray, digits: int = ORDER_DIGITS) -> np.ndarray:
    """Halves go away from zero, as SQL's `round` has them."""
    with np.errstate(all="ignore"):
        scaled = values * 10.0**digits
        whole = np.copysign(np.floor(np.abs(scaled) + 0.5), scaled)
        out = np.where(np.abs(scaled) < 2.0**52, whole, scaled) / 10.0**digits
    return np.where(np.isfinite(out), out, values) + 0.0


def summed(a: np.ndarray, b: np.ndarray, term: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """Sums of the terms of two matrices' columns, one component after another."""
    out = np.zeros(a.shape[1])
    for x, y in zip(a, b, strict=True):
        out += term(x, y)
    return out


def product(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return x * y


def gap(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x - y) * (x - y)


#: Vectors, and which are missing, from a column that holds them in another form, of the rows of a cell.
Decode = Callable[[pa.Array, int], tuple[np.ndarray, np.ndarray]]


class Run:
    """A run's vectors, and how far they are from those of queries."""

    def __init__(self, metric: str, points: np.ndarray, absent: np.ndarray) -> None:
        self.metric, self.points, self.absent = metric, points, absent
        self.columns = np.ascontiguousarray(points.T)
        with np.errstate(all="ignore"):
            self.sizes = np.sqrt(summed(self.columns, self.columns, product))
            self.scaled = points / np.where(self.sizes > 0, self.sizes, 1)[:, None] if metric == "cosine" else points
        known = self.sizes[np.isfinite(self.sizes)]
        self.largest = float(known.max()) if len(known) else 0.0

    def near(self, queries: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(distances of queries to all rows, as products have them, what each query's may be wrong by)."""
        with np.errstate(all="ignore"):
            if self.metric == "cosine":
                out = 1 - (queries / np.where(sizes > 0, sizes, 1)[:, None]) @ self.scaled.T
                wrong = np.full(len(queries), 1.0)
            elif self.metric == "dot":
                out = 1 - queries @ self.points.T
                wrong = 1 + sizes * self.largest
            else:
                out = queries @ (-2 * self.points.T)
                out += (self.sizes**2)[None, :]
                out += (sizes**2)[:, None]
                wrong = (sizes + self.largest) ** 2
            if not np.isfinite(out.sum()):
                out[np.isnan(out)] = np.inf
        return out, SLACK * np.where(np.isfinite(wrong), wrong, 0.0)

    def measured(self, queries: np.ndarray, sizes: np.ndarray, q: np.ndarray, r: np.ndarray) -> np.ndarray:
        """The distances of pairs of a query and a row, by their places; queries are columns here."""
        out = np.empty(len(q))
        with np.errstate(all="ignore"):
            for start in range(0, len(q), MEASURED):
                i, j = q[start : start + MEASURED], r[start : start + MEASURED]
                a, b = self.columns[:, j], queries[:, i]
                if self.metric == "l2":
                    out[start : start + MEASURED] = summed(a, b, gap)
                    continue
                inner = summed(a, b, product)
                if self.metric == "cosine":
                    size = self.sizes[j] * sizes[i]
                    inner = np.where(size == 0, 0.0, inner / np.where(size == 0, 1, size))
                out[start : start + MEASURED] = 1 - inner
        return out


def runs(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.Table]:
    """The batches' rows in runs of some `RUN` components."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n * max(width, 1) >= RUN:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def column(table: pa.Table | pa.RecordBatch, name: str) -> pa.Array:
    out = table.column(name)
    return out.combine_chunks() if isinstance(out, pa.ChunkedArray) else out


def places(ids: pa.Array) -> np.ndarray:
    """The place of each id in their order; rows without one come last."""
    out = np.empty(len(ids), np.int64)
    out[pc.sort_indices(ids, null_placement="at_end").to_numpy()] = np.arange(len(ids))
    return out


def scanner(asked: Asked, k: int, metric: str, id_column: str, keep: list[str], vector: str, cell: str | None, decode: Decode | None = None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What a task does with its rows."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, width = asked.points.shape
        with np.errstate(all="ignore"):
            sizes = np.sqrt(summed(asked.points.T, asked.points.T, product))
        best = np.full((n, k), np.inf)  # of each query, the least rounded distances so far
        for table in runs(batches, width):
            of = np.zeros(table.num_rows, np.int64) if cell is None else column(table, cell).to_numpy(zero_copy_only=False).astype(np.int64)
            for own in np.unique(of):
                rows = table if cell is None else table.filter(pa.array(of == own))
                who = np.arange(n) if asked.probes is None else np.flatnonzero(asked.probes[:, own])
                points, absent = matrix(column(rows, vector), width) if decode is None else decode(column(rows, vector), own)
                run, order = Run(metric, points, absent), places(column(rows, id_column))
                step = max(1, TILE // max(1, len(order)))
                for start in range(0, len(who), step):
                    yield from tile(run, rows, order, who[start : start + step], sizes, best)

    def tile(run: Run, rows: pa.Table, order: np.ndarray, who: np.ndarray, sizes: np.ndarray, best: np.ndarray) -> Iterator[pa.RecordBatch]:
        queries, long = asked.points[who], sizes[who]
        about, wrong = run.near(queries, long)
        most = best[who].max(1)
        open_ = np.flatnonzero(np.isinf(most))
        if len(open_) and len(order) > k:
            most[open_] = np.partition(about[open_], k - 1, 1)[:, k - 1]
        room = 2.0 * 10.0**-ORDER_DIGITS + 2 * wrong + SLACK * np.where(np.isfinite(most), np.abs(most), 0.0)
        q, r = np.nonzero(about <= (most + room)[:, None])
        del about
        if not len(q):
            return
        distance = run.measured(np.ascontiguousarray(queries.T), long, q, r)
        none = run.absent[r] | asked.absent[who[q]]
        kind = np.where(none, 2, np.isnan(distance))
        key = rounded(distance)
        by = np.lexsort((order[r], np.where(kind == 0, key, 0), kind, q))
        first = np.r_[True, q[by][1:] != q[by][:-1]]
        place = np.arange(len(by)) - np.maximum.accumulate(np.where(first, np.arange(len(by)), 0))
        by, place = by[place < k], place[place < k]
        q, r, distance, key, kind, none = q[by], r[by], distance[by], key[by], kind[by], none[by]
        fresh = np.full((len(who), k), np.inf)
        fresh[q[kind == 0], place[kind == 0]] = key[kind == 0]
        best[who] = np.partition(np.concatenate([best[who], fresh], 1), k - 1, 1)[:, :k]
        taken = rows.select([id_column, *keep]).take(pa.array(r))
        missing = pa.array(none) if none.any() else None
        parts = [asked.ids.take(pa.array(who[q])), *(column(taken, c) for c in (id_column, *keep))]
        parts += [pc.if_else(missing, None, pa.array(x)) if missing is not None else pa.array(x) for x in (distance, key)]
        yield pa.RecordBatch.from_arrays(parts, ["query_id", id_column, *keep, "dense_distance", "_key"])

    return scan


def asked_of(queries: DataFrame, probes: Callable[[np.ndarray], np.ndarray] | None = None, width: int | None = None) -> Asked:
    """Queries (query_id, _q) on the driver, in vectors of the given number of components."""
    got = queries.toArrow()
    vectors = column(got, "_q")
    points, absent = matrix(vectors, width if width is not None else pc.max(pc.list_value_length(vectors)).as_py() or 1)
    return Asked(column(got, "query_id"), points, absent, None if probes is None else probes(points))


def nearest(rows: DataFrame, queries: DataFrame, k: int, metric: str, id_column: str, keep: list[str], vector: str, block: int, cell: str | None = None, probes: Callable[[np.ndarray], np.ndarray] | None = None, decode: Decode | None = None) -> DataFrame:
    """query_id, id, the kept columns, dense_distance and `_key` (its rounded value): what may be among the k nearest of each query.

    `queries` has query_id and `_q` (array<double>). A query looks at the rows of all cells, or of those that `probes` says of its vector.
    """
    fields = [T.StructField("query_id", queries.schema["query_id"].dataType), *(T.StructField(c, rows.schema[c].dataType) for c in (id_column, *keep))]
    shape = T.StructType([*fields, *(T.StructField(c, T.DoubleType()) for c in ("dense_distance", "_key"))])
    needed = list(dict.fromkeys([id_column, *keep, vector, *([cell] if cell else [])]))
    size = F.greatest(F.coalesce(F.size("_q"), F.lit(0)), F.lit(0))
    parts = []
    for width, n in sorted(map(tuple, queries.groupBy(size).agg(F.count("*")).collect())):
        same = queries.where(size == width)
        held = max(1, min(block, HELD // max(width, 1), HELD // k))
        for i in range(blocks := -(-n // held)):
            some = same if blocks == 1 else same.where(F.pmod(F.xxhash64("query_id", "_q"), F.lit(blocks)) == i)
            found = rows.select(*needed).mapInArrow(scanner(asked_of(some, probes, width or 1), k, metric, id_column, keep, vector, cell, decode), shape)
            parts.append((found, blocks > 1))
    if not parts:
        return rows.sparkSession.createDataFrame([], shape)
    out = [written(found) if many or len(parts) > 1 else found for found, many in parts]
    whole = out[0]
    for part in out[1:]:
        whole = whole.unionByName(part)
    return whole


def beside(pairs: DataFrame, queries: DataFrame, metric: str, id_column: str, vector: str) -> DataFrame:
    """query_id, id, dense_distance, `_key` of pairs of a query's id and a row with its vector; the queries are sent to the tasks."""
    asked = asked_of(queries)
    order = places(asked.ids)
    ids = asked.ids.take(pa.array(np.argsort(order)))
    points, shape = asked.points[np.argsort(order)], T.StructType([pairs.schema["query_id"], pairs.schema[id_column], *(T.StructField(c, T.DoubleType()) for c in ("dense_distance", "_key"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(all="ignore"):
            sizes = np.sqrt(summed(points.T, points.T, product))
        for batch in batches:
            own, absent = matrix(column(batch, vector), points.shape[1])
            at = pc.index_in(column(batch, "query_id"), value_set=ids).to_numpy(zero_copy_only=False)
            distance = Run(metric, own, absent).measured(np.ascontiguousarray(points.T), sizes, at, np.arange(len(at)))
            parts = [pc.if_else(pa.array(absent), None, pa.array(x)) for x in (distance, rounded(distance))]
            yield pa.RecordBatch.from_arrays([column(batch, "query_id"), column(batch, id_column), *parts], ["query_id", id_column, "dense_distance", "_key"])

    return pairs.select("query_id", id_column, vector).mapInArrow(run, shape)
