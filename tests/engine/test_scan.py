"""The scan by matrix products finds what a sorted list of all pairs finds, and no plan pairs all rows."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.operators import ann, dense, diversity, scan, similar


def distance(metric, a, b):
    if a is None or b is None or len(a) != len(b) or None in a:
        return None
    inner = sum(x * y for x, y in zip(a, b, strict=True))
    if metric == "dot":
        return 1 - inner
    if metric == "l2":
        return sum((x - y) * (x - y) for x, y in zip(a, b, strict=True))
    size = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
    return 1 - (inner / size if size else 0.0)


def listed(rows, asked, k, metric):
    out = set()
    for q, v in asked:
        kind = lambda d: 2 if d is None else int(math.isnan(d))
        every = sorted((kind(d := distance(metric, x, v)), round(d, 9) if kind(d) == 0 else 0, i) for i, x in rows)
        out |= {(q, n, i) for n, (_, _, i) in enumerate(every[:k])}
    return out


@pytest.mark.parametrize("metric", ["cosine", "dot", "l2"])
def test_the_nearest_are_those_of_all_pairs(spark, monkeypatch, metric):
    """Copies tie by id; vectors that are missing, broken or not a number come last, whatever the runs and tiles."""
    r = np.random.default_rng(3)
    own = [[float(np.float32(x)) for x in r.normal(size=6)] for _ in range(90)]
    rows = [(3 * i % 271, own[i % 90]) for i in range(270)] + [(300, None), (301, own[0][:5]), (302, [0.0] * 6), (303, [math.nan] * 6), (304, [None] * 6)]
    asked = [(q, own[q]) for q in range(0, 90, 7)] + [(95, [0.0] * 6), (96, None)]
    chunks = spark.createDataFrame(rows, "chunk_id long, vector array<float>").repartition(3)
    queries = spark.createDataFrame(asked, "query_id long, query_vector array<float>")
    for k in (4, 274):
        want = listed(rows, asked, k, metric)
        for run, tile in ((1 << 21, 1 << 22), (60, 40)):
            monkeypatch.setattr(scan, "RUN", run)
            monkeypatch.setattr(scan, "TILE", tile)
            found = dense.topk(chunks, queries, k, metric)
            assert {(x["query_id"], x["dense_rank"], x["chunk_id"]) for x in found.collect()} == want


def test_no_plan_pairs_rows_with_queries(spark):
    chunks = spark.range(50).select(F.col("id").alias("chunk_id"), F.array(F.col("id").cast("float"), F.lit(1.0).cast("float")).alias("vector"))
    queries = chunks.where("chunk_id < 3").select(F.col("chunk_id").alias("query_id"), F.col("vector").alias("query_vector"))
    plan = dense.topk(chunks, queries, 2)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Join" not in plan and "CartesianProduct" not in plan


def test_halves_go_away_from_zero():
    assert scan.rounded(np.array([2.0**-10, -(2.0**-10), -1e-17, 1e300])).tolist() == [0.000976563, -0.000976563, 0.0, 1e300]


def test_mmr_ties_in_digits_go_to_the_earliest():
    """The third candidate is better by 2e-8, which is a tie in seven digits."""
    vectors = [[1.0, 0.0, 0.0], [0.6, 0.8, 0.0], [0.6, 0.7999999, 0.0]]
    assert diversity.select_mmr(vectors, [1.0, 0.0, 0.0], np.array([1.0, 0.6, 0.6]), 0.7, 3) == [0, 1, 2]


def test_similar_candidates_share_several_first_terms(spark):
    """Chunks that have one rare term in common aren't compared; the others of their terms are as rare, in chunks of another size."""
    rows = [(i, [f"own{i}-{j}" for j in range(10)] + [f"pair{i // 2}"] + [f"w{i}-{j}" for j in range(49)]) for i in range(60)]
    rows += [(1000 + i, [f"w{i}-{j}" for j in range(49)] + [f"more{i}-{j}" for j in range(60)]) for i in range(60)]
    sets = similar.classes(spark.createDataFrame(rows, "chunk_id long, terms array<string>"), F.col("terms"))
    assert similar.candidates(sets, 0.6).count() == 0


def test_all_cells_are_exact_however_short_the_list(spark, tmp_path):
    r = np.random.default_rng(4)
    frame = spark.createDataFrame([(i, [float(x) for x in r.normal(size=8)]) for i in range(400)], "chunk_id long, vector array<float>")
    asked = frame.where("chunk_id % 40 = 0").select(F.col("chunk_id").alias("query_id"), F.col("vector").alias("query_vector"))
    index = ann.build(frame, str(tmp_path / "ix"), 3)
    rows = lambda found: sorted((x["query_id"], x["dense_rank"], x["chunk_id"]) for x in found.collect())
    assert rows(index.search(asked, 10, 3, 1)) == rows(dense.topk(frame, asked, 10))
