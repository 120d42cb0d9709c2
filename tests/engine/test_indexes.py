"""Indexes and orders: equal to scans, pruned reads, partial rewrites, and no order made in one task."""

from __future__ import annotations

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.operators import ann, dense, evaluation, grouping, lexical, similar
from quillstone.operators.blocks import PostingBlocks
from quillstone.operators.positions import placed, positions
from quillstone.schema import QueryError
from quillstone.sources.slots import SlotTable

WORDS = [f"w{i}" for i in range(200)]


@pytest.fixture(scope="module")
def vectors(spark):
    r = np.random.default_rng(1)
    centres = r.normal(size=(12, 24))
    rows = [(i, [float(x) for x in centres[i % 12] + 0.3 * r.normal(size=24)]) for i in range(900)] + [(5000 + i, [float(x) for x in centres[0]]) for i in range(5)] + [(9000, None)]
    return spark.createDataFrame(rows, "chunk_id long, vector array<float>").repartition(3).cache()


@pytest.fixture(scope="module")
def asked(vectors):
    return vectors.where("chunk_id % 50 = 0 AND vector IS NOT NULL").select(F.col("chunk_id").alias("query_id"), F.col("vector").alias("query_vector"))


def found(frame):
    return sorted((r["query_id"], r["dense_rank"], r["chunk_id"], round(r["dense_distance"], 9)) for r in frame.collect())


@pytest.mark.parametrize("metric", ["cosine", "dot", "l2"])
def test_codes_find_what_a_scan_finds(vectors, asked, tmp_path, metric):
    index = ann.build(vectors, str(tmp_path / "ix"), 12, metric)
    exact = dense.topk(vectors.where("vector IS NOT NULL"), asked, 10, metric)
    assert found(index.search(asked, 10, 12, 200)) == found(exact)
    assert ann.recall(index.search(asked, 10), exact).first()[0] >= 0.9
    few = [ann.recall(index.search(asked, 10, n, 20), exact).first()[0] for n in (1, 2, 4, 12)]
    assert few == sorted(few) and few[-1] > 0.99


def test_codes_read_probed_partitions_and_no_vectors_first(vectors, asked, tmp_path):
    index = ann.build(vectors, str(tmp_path / "ix"), 12)
    near = index.nearest_cells(asked.limit(1), 2)
    plan = index.estimates(near)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell#" in plan and "codes:array<smallint>" in plan and "vector:array" not in plan.split("ReadSchema: struct<chunk_id:bigint,codes")[1][:40]
    assert len([d for d in os.listdir(tmp_path / "ix") if d.startswith("cell=")]) == 12
    cells = {r[0] for r in near.select("cell").collect()}
    assert {r[0] for r in index.probed(near).select("cell").distinct().collect()} == cells and len(cells) == 2
    with pytest.raises(QueryError):
        index.search(asked, 0)


def test_ties_are_settled_by_id(vectors, tmp_path):
    index = ann.build(vectors, str(tmp_path / "ix"), 12, "l2")
    one = vectors.where("chunk_id = 5003").select(F.col("chunk_id").alias("query_id"), F.col("vector").alias("query_vector"))
    assert [r["chunk_id"] for r in index.search(one, 5).orderBy("dense_rank").collect()] == [5000, 5001, 5002, 5003, 5004]


@pytest.fixture(scope="module")
def chunks(spark):
    r = random.Random(2)
    rows = [(i, " ".join(r.choices(WORDS, [1 / (k + 1) for k in range(200)], k=r.choice([3, 20, 90])))) for i in range(600)] + [(700, None), (701, ""), (702, "w0 " * 500), (703, "w199 w198 w197"), (704, "W199, w198! w197")]
    return spark.createDataFrame(rows, "chunk_id long, text string").repartition(3).cache()


def scored(frame):
    return sorted((r["query_id"], r["lexical_rank"], r["chunk_id"], round(r["lexical_score"], 9)) for r in frame.collect())


def test_blocks_find_what_all_postings_find(spark, chunks, tmp_path):
    asked = spark.createDataFrame([(1, "w199 w198 w197"), (2, "w0 w1"), (3, "unknown"), (4, ""), (5, "w150 w3 w150")], "query_id long, query string")
    blocks = PostingBlocks(spark, str(tmp_path / "b"), 8, 1).build(chunks)
    assert scored(blocks.search(asked, 7)) == scored(lexical.bm25(chunks, asked, 7))
    some = chunks.where("chunk_id % 3 = 0")
    assert scored(blocks.search(asked, 7, some)) == scored(lexical.bm25(chunks, asked, 7, "chunk_id % 3 = 0"))
    assert blocks.stats() == (605, pytest.approx(lexical.corpus_stats(chunks).first()["avg_len"]))
    assert sorted(blocks.frequencies().collect()) == sorted(lexical.document_frequency(lexical.postings(chunks)).collect())
    read = {r["query_id"]: (r["blocks"], r["blocks_read"]) for r in blocks.reading(asked, 2).collect()}
    assert all(b <= a for a, b in read.values()) and read[1][1] < read[1][0] / 2 and 3 not in read


def test_a_change_rewrites_the_slots_of_its_ids_only(spark, chunks, tmp_path):
    path = tmp_path / "b"
    blocks = PostingBlocks(spark, str(path), 64, 1).build(chunks)
    files = lambda: {d: sorted(os.listdir(path / d)) for d in os.listdir(path) if d.startswith("slot=")}
    before = files()
    assert len(before) == 64
    fresh = spark.createDataFrame([(3, "all of it is new"), (9001, "w199 new"), (10, None)], "chunk_id long, text string")
    gone = spark.createDataFrame([(5,), (77777,)], "chunk_id long")
    touched = blocks.change(fresh, gone)
    after = files()
    assert {d for d in after if after[d] != before[d]} == {f"slot={s}" for s in touched} and len(touched) <= 5
    now = chunks.where("chunk_id NOT IN (3, 5, 10)").unionByName(fresh)
    asked = spark.createDataFrame([(1, "new w199"), (2, "w0 w1 of")], "query_id long, query string")
    assert scored(blocks.search(asked, 9)) == scored(lexical.bm25(now, asked, 9))
    assert sorted(blocks.frequencies().collect()) == sorted(lexical.document_frequency(lexical.postings(now)).collect())
    assert blocks.change(chunks.where("false")) == []
    blocks.change(chunks.where("false"), now.select("chunk_id"))
    assert blocks.stats() == (0, 0.0) and blocks.search(asked, 3).count() == 0 and len(files()) == 64


def test_positions_are_those_of_one_sorted_list(spark):
    r = random.Random(8)
    rows = [(r.choice(["a", "b", None]), r.randint(0, 9), i) for i in range(3000)]
    frame = spark.createDataFrame(rows, "g string, x int, i int").repartition(5)
    key = lambda t: (t[0] is not None, t[0] or "", -t[1], t[2])
    want = {t[2]: p for p, t in enumerate(sorted(rows, key=key))}
    assert {x["i"]: x["position"] for x in positions(frame, ["g", F.col("x").desc(), "i"]).collect()} == want
    firsts, sizes = {}, {}
    for t in sorted(rows, key=key):
        firsts.setdefault(t[0], want[t[2]])
        sizes[t[0]] = sizes.get(t[0], 0) + 1
    got = placed(frame, ["g"], [F.col("x").desc(), "i"], "p", "n").collect()
    assert {x["i"]: (x["p"], x["n"]) for x in got} == {t[2]: (want[t[2]] - firsts[t[0]], sizes[t[0]]) for t in rows}
    assert placed(frame.where("false"), ["g"], ["x"], "p").count() == 0 == positions(frame.where("false"), ["x"]).count()


def test_orders_of_presentation_have_no_window_in_one_task(spark):
    """Every document has a path of its own: nothing is windowed without a part, nothing is sorted in one task."""
    rows = [(0, i, f"root/f{i % 7}/Day {i}.md", f"f{i % 7}", float(i % 50)) for i in range(500)]
    hits = spark.createDataFrame(rows, "query_id int, chunk_index int, file_path string, folder string, score double")
    placed_ = grouping.document_places(grouping.grouped_order(hits))
    plan = placed_._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SinglePartition" not in plan
    got = {r["chunk_index"]: (r["position"], r["document_index"], r["document_total"]) for r in placed_.collect()}
    best = {f: max(x[4] for x in rows if x[3] == f) for f in {x[3] for x in rows}}
    order = sorted(rows, key=lambda x: (-best[x[3]], x[3], x[1]))
    inside = {}
    for at, x in enumerate(order):
        inside[x[3]] = inside.get(x[3], 0) + 1
        assert got[x[1]] == (at, inside[x[3]], sum(y[3] == x[3] for y in rows))


def test_a_slot_table_rewrites_the_slots_of_changed_keys(spark, tmp_path):
    path = tmp_path / "t"
    t = SlotTable(spark, str(path), T.StructType.fromDDL("k long, v string"), "k", 32)
    assert t.read().count() == 0 and t.delete("k = 1") == [] and t.compact() == []
    t.append(spark.range(1000).selectExpr("id AS k", "'a' AS v"))
    files = lambda: {d: sorted(f for f in os.listdir(path / d) if f.endswith(".parquet")) for d in os.listdir(path) if d.startswith("_slot=")}
    changed = lambda a, b: {d for d in b if a.get(d) != b[d]}
    before = files()
    one = t.upsert(spark.createDataFrame([(7, "b")], "k long, v string"))
    after = files()
    assert len(one) == 1 and changed(before, after) == {f"_slot={one[0]}"}
    assert t.delete_ids(spark.createDataFrame([(7,), (5000,)], "k long")) == sorted(t.delete_ids(spark.createDataFrame([(7,), (5000,)], "k long")))
    before = files()
    gone = t.delete("k IN (8, 9)")
    assert 1 <= len(gone) <= 2 and changed(before, files()) == {f"_slot={s}" for s in gone}
    t.append(spark.createDataFrame([(2000, "c")], "k long, v string"))
    assert len(t.compact()) == 1 and t.compact() == []
    assert {(r["k"], r["v"]) for r in t.read().collect()} == {(k, "a") for k in range(1000) if k not in (7, 8, 9)} | {(2000, "c")}
    t.change(spark.createDataFrame([(1, "new")], "k long, v string"), t.read().select("k"))
    assert [tuple(r) for r in t.read().collect()] == [(1, "new")]
    t.delete("v = 'new'")
    assert t.read().count() == 0 and t.read().columns == ["k", "v"]


def test_order_statistics_by_histograms(spark):
    r = random.Random(6)
    groups = {"hot": [r.gauss(0, 1) for _ in range(4000)] + [0.5] * 500, "one": [3.0], "two": [1.0, 2.0], "same": [7.0] * 9, "wide": [-1e308, 1e308, 0.0, 1e-300, 2e-300], None: [5.0, 4.0, 6.0], "none": []}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("none", None), ("none", float("nan")), ("two", None)]
    out = {x["g"]: (x["n"], x["median"], x["percentile"]) for x in evaluation.latency(spark.createDataFrame(rows, "g string, v double").repartition(4), ["g"], "v").collect()}

    def expected(vs):
        vs, n = sorted(vs), len(vs)
        return (n, (vs[(n + 1) // 2 - 1] + vs[n // 2]) / 2, vs[max(1, -(-95 * n // 100)) - 1]) if n else (0, None, None)

    assert out == {g: expected(vs) for g, vs in groups.items()}


@pytest.mark.parametrize("threshold", [0.5, 0.8])
def test_similar_pairs_equal_all_pairs(spark, threshold):
    r = random.Random(5)
    base = [f"term{i}" for i in range(40)]
    rows = [(i, ["common", *r.sample(base, r.randint(1, 12))]) for i in range(120)]
    rows += [(200 + i, ["common", *base[: 20 + i % 6], f"own{i % 4}"]) for i in range(40)] + [(300, []), (301, None), (302, ["common"]), (None, ["common", *base[:20]]), (303, ["common", "common"])]
    frame = spark.createDataFrame(rows, "chunk_id long, terms array<string>").repartition(3)
    classes = {}
    for i, terms in rows:
        if terms:
            classes.setdefault(frozenset(terms), []).append(i)
    named = sorted((min(i for i in ids if i is not None), len(ids), s) for s, ids in classes.items() if any(i is not None for i in ids))
    want = sorted((a, b, n, m, len(s & t)) for a, n, s in named for b, m, t in named if a < b and len(s & t) >= threshold * len(s | t) - 1e-9)
    got = similar.similar_pairs(frame, threshold, F.coalesce("terms", F.array().cast("array<string>")))
    assert sorted((x["a"], x["b"], x["n_a"], x["n_b"], x["overlap"]) for x in got.collect()) == want
    tried = similar.candidates(similar.classes(frame, F.col("terms")), threshold).count()
    assert len(want) <= tried < len(named) * (len(named) - 1) / (4 if threshold == 0.5 else 12)
    assert similar.similar_pairs(frame.where("false"), threshold, F.col("terms")).count() == 0
