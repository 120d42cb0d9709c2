"""Retrieval operators against worked examples."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillstone import queries
from quillstone.functions import vectors as V
from quillstone.operators import dense, diversity, evaluation, expansion, fusion, lexical, predicates, sampling
from quillstone.plans.search import Options, search
from quillstone.schema import ConfigurationError, QueryError

CHUNKS = [
    ("c1", "alpha.md", 0, "prose", "Neural processing units accelerate matrix multiplication", [1.0, 0.0, 0.0]),
    ("c2", "alpha.md", 1, "table", "Quantum computing algorithms utilize qubit superposition", [0.0, 1.0, 0.0]),
    ("c3", "beta.md", 0, "prose", "Traditional relational databases optimize b-tree indices", [0.0, 0.0, 1.0]),
]


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame(CHUNKS, "chunk_id string, file_path string, chunk_index long, chunk_kind string, text string, vector array<float>").withColumn("token_count", F.lit(7).cast("long")).withColumn("author", F.lit("a")).cache()


def ask(spark, text="matrix multiplication", vector=(1.0, 0.0, 0.0)):
    return spark.createDataFrame([(0, text, list(vector))], "query_id int, query string, query_vector array<float>")


def found(frame, *columns):
    return [tuple(r[c] for c in columns) for r in frame.collect()]


def test_dense(spark, chunks):
    rows = dense.topk(chunks, ask(spark), 3).orderBy("dense_rank").collect()
    assert [(r["chunk_id"], r["dense_rank"], r["dense_distance"], r["score"]) for r in rows] == [("c1", 0, 0.0, 1.0), ("c2", 1, 1.0, 0.0), ("c3", 2, 1.0, 0.0)]
    assert found(dense.topk(chunks, ask(spark), 3, filter_sql="file_path = 'beta.md'"), "chunk_id") == [("c3",)]
    assert found(dense.topk(chunks, ask(spark), 2, filter_sql="chunk_kind = 'table'", prefilter=False, keep=("chunk_kind",)), "chunk_id") == [("c2",)]
    assert dense.topk(chunks, ask(spark), 1, filter_sql="chunk_kind = 'table'", prefilter=False, keep=("chunk_kind",)).count() == 0
    assert found(dense.topk(chunks, ask(spark), 1, "l2"), "dense_distance", "score") == [(0.0, 1.0)]
    for bad in ("no such column = 1", "((("):
        with pytest.raises(QueryError):
            dense.topk(chunks, ask(spark), 3, filter_sql=bad).collect()
    with pytest.raises(QueryError):
        dense.topk(chunks, ask(spark), 0)


def test_dense_in_blocks_of_queries(spark, chunks, monkeypatch):
    many = spark.createDataFrame([(i, [float(i == 0), float(i == 1), 0.1]) for i in range(9)], "query_id int, query_vector array<float>")
    whole = sorted(found(dense.topk(chunks, many, 2), "query_id", "chunk_id", "dense_rank"))
    monkeypatch.setattr(dense, "QUERY_BLOCK", 4)
    assert sorted(found(dense.topk(chunks, many, 2), "query_id", "chunk_id", "dense_rank")) == whole


def test_cells_with_all_probes_equal_the_scan(spark):
    r = np.random.default_rng(1)
    rows = [(i, [float(x) for x in r.normal(size=8)]) for i in range(200)]
    frame = spark.createDataFrame(rows, "chunk_id int, vector array<float>")
    asked = spark.createDataFrame([(k, [float(x) for x in r.normal(size=8)]) for k in range(5)], "query_id int, query_vector array<float>")
    celled, centres = dense.build_cells(frame, 6)
    exact = sorted(found(dense.topk(frame, asked, 5), "query_id", "chunk_id", "dense_rank"))
    assert sorted(found(dense.search_cells(celled, centres, asked, 5, nprobes=6), "query_id", "chunk_id", "dense_rank")) == exact
    some = set(found(dense.search_cells(celled, centres, asked, 5, nprobes=3), "query_id", "chunk_id"))
    assert len(some & {(q, c) for q, c, _ in exact}) >= 12


def test_lexical(spark, chunks):
    rows = lexical.bm25(chunks, ask(spark), 5).collect()
    assert [(r["chunk_id"], r["lexical_rank"]) for r in rows] == [("c1", 0)] and rows[0]["lexical_score"] > 0
    assert lexical.bm25(chunks, ask(spark, "zzz"), 5).count() == 0
    assert found(lexical.bm25(chunks, ask(spark, '"matrix" (+qubit)?!'), 5).orderBy("lexical_rank"), "chunk_id") == [("c1",), ("c2",)]
    table = lexical.postings(chunks).cache()
    assert found(lexical.bm25(chunks, ask(spark), 5, table=table), "chunk_id") == [("c1",)]
    assert lexical.bm25(chunks, ask(spark), 5, "chunk_kind = 'table'").count() == 0


def test_documents_without_a_vector_do_not_crowd_out_lexical_candidates(spark, tmp_path):
    documents = [(i, "alpha", "en", "s", 5) for i in range(1100)] + [(2000 + i, "alpha " + "beta " * (9 + i), "en", "s", 60) for i in range(3)]
    spark.createDataFrame(documents, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    vectors = [(i, [1.0, float(i)], i) for i in (2000, 2001, 2002, 5000)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label long").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([(0, "alpha")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for depth, best in ((1, [(2000, 0)]), (2, [(2000, 0), (2001, 1)])):
        words = queries._parts(spark, str(tmp_path), depth)[1]
        assert found(words.orderBy("lexical_rank"), "chunk_id", "lexical_rank") == best


def lists(spark):
    d = spark.createDataFrame([(0, "d1", 0.1, 0, 0.9), (0, "d2", 0.15, 1, 0.85)], "query_id int, chunk_id string, dense_distance double, dense_rank int, score double")
    x = spark.createDataFrame([(0, "d3", 25.0, 0), (0, "d1", 20.0, 1)], "query_id int, chunk_id string, lexical_score double, lexical_rank int")
    return d, x


def test_fusion(spark):
    d, x = lists(spark)
    rows = fusion.rrf(d, x).orderBy("rank").collect()
    assert [r["chunk_id"] for r in rows] == ["d1", "d3", "d2"]
    assert [r["score"] for r in rows] == pytest.approx([1 / 61 + 1 / 62, 1 / 61, 1 / 62])
    weighted = {r["chunk_id"]: r["score"] for r in fusion.rrf(d, x, 20, 5.0, 1.0).collect()}
    assert weighted["d2"] == pytest.approx(5 / 22) and weighted["d3"] == pytest.approx(1 / 21)
    rows = {r["chunk_id"]: r["score"] for r in fusion.linear(d, x, 0.5).collect()}
    assert rows == pytest.approx({"d1": 0.5, "d3": 0.5, "d2": 0.0})
    assert fusion.rrf(d, x, limit=1).count() == 1
    lone = fusion.rrf(d.limit(0), x).orderBy("rank").collect()
    assert [r["chunk_id"] for r in lone] == ["d3", "d1"]
    for wrong in (lambda: fusion.rrf(d, x, 0), lambda: fusion.rrf(d, x, 60, -1.0), lambda: fusion.linear(d, x, 1.5)):
        with pytest.raises(ConfigurationError):
            wrong()


def test_equal_scores_scale_to_one(spark):
    d, x = lists(spark)
    same = d.withColumn("score", F.lit(0.7))
    assert {r["score"] for r in fusion.linear(same, x.limit(0), 1.0).collect()} == {1.0}


def test_mmr_examples():
    q = np.array([1.0, 0, 0])
    assert diversity.select_mmr([[1, 0, 0], [0.999, 0.01, 0], [0.707, 0.707, 0]], q, np.zeros(3), 0.4, 2) == [0, 2]
    assert diversity.select_mmr([[1, 0, 0], [0.9, 0.1, 0], [0.5, 0.5, 0]], q, np.zeros(3), 1.0, 3) == [0, 1, 2]
    assert diversity.select_mmr([], q, np.zeros(0), 0.5, 3) == [] and diversity.select_mmr([[1, 0, 0]], q, np.zeros(1), 0.5, 0) == []
    assert diversity.select_mmr([None, None, [0, 1, 0]], q, np.array([0.2, 0.9, 0.0]), 0.5, 3)[0] == 1


@given(st.integers(0, 10_000), st.floats(0, 1), st.integers(1, 6))
@settings(max_examples=60, deadline=None)
def test_mmr_equals_the_definition(seed, weight, limit):
    r = np.random.default_rng(seed)
    v = r.normal(size=(8, 4)).astype(np.float32)
    q = r.normal(size=4).astype(np.float32)
    cos = lambda a, b: float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b)))
    got = diversity.select_mmr(list(v), q, np.zeros(8), weight, limit)
    assert len(got) == len(set(got)) == limit
    for step, pick in enumerate(got):
        before = got[:step]
        value = {i: weight * cos(v[i], q) - (1 - weight) * max(cos(v[i], v[j]) for j in before) if before else cos(v[i], q) for i in range(8) if i not in before}
        assert value[pick] >= max(value.values()) - 1e-5


def results(spark):
    rows = [(0, f"c{i + 1}", f, i, i, 1.0 - i / 10, f"t{i + 1}", 10 + i, "prose") for i, f in enumerate(["alpha"] * 3 + ["beta"] * 2)]
    return spark.createDataFrame(rows, "query_id int, chunk_id string, file_path string, chunk_index long, rank int, score double, text string, token_count long, chunk_kind string")


def test_caps_and_rollups(spark):
    r = results(spark)
    assert [x for (x,) in found(diversity.cap_per_document(r, 2).orderBy("rank"), "chunk_id")] == ["c1", "c2", "c4", "c5"]
    assert [x for (x,) in found(diversity.rollup_best(r).orderBy("rank"), "chunk_id")] == ["c1", "c4"]
    one = diversity.rollup_aggregate(r).orderBy("rank").collect()
    assert [(x["chunk_id"], x["token_count"], x["chunk_kind"]) for x in one] == [("c1", 33, "document"), ("c4", 27, "document")]
    assert one[0]["text"] == "t1\n\n---\n\nt2\n\n---\n\nt3"


def test_expansion(spark):
    rows = [(f"a{i}", "A", i, f"A{i}") for i in range(4)] + [(f"b{i}", "B", i, f"B{i}") for i in range(2)]
    all_ = spark.createDataFrame(rows, "chunk_id string, file_path string, chunk_index long, text string")
    hit = lambda c: all_.where(F.col("chunk_id") == c).withColumn("query_id", F.lit(0))
    context = lambda c, w: expansion.expand(hit(c), all_, w).first()["expanded_context"]
    assert context("a1", 1) == "A0\n\nA1\n\nA2" and context("a0", 1) == "A0\n\nA1" and context("a3", 9) == "A0\n\nA1\n\nA2\n\nA3" and context("b1", 0) == "B1"
    with pytest.raises(QueryError):
        expansion.expand(hit("a1"), all_, -1)
    assert found(expansion.window_of_all(all_, 1).where("chunk_id = 'a1'"), "expanded_context") == [("A0\n\nA1\n\nA2",)]


SCOPES = [("p1", "O'Brien", "O'Brien/x.md"), ("p2", "a_b", "a_b/x.md"), ("p3", "axb", "axb/x.md"), ("p4", "50%", "50%/x.md"), ("p5", "500", "500/x.md"), ("p6", "Vol 1", "Vol 1/x.md"), ("p7", "Vol 10", "Vol 10/x.md"), ("p8", "Parent", "Parent\\Child\\x.md"), ("p9", "Parent", "Parent/Child/x.md"), ("pa", "भगवान", "भगवान/x.md"), ("pb", None, "x.md")]


@pytest.mark.parametrize(("folder", "ids"), [("O'Brien", {"p1"}), ("a_b", {"p2"}), ("50%", {"p4"}), ("Vol ?", {"p6"}), ("Vol*", {"p6", "p7"}), ("Parent/Child", {"p8", "p9"}), ("Parent\\Child", {"p8", "p9"}), ("भगवान", {"pa"}), ("parent", set()), ("x' OR '1'='1", set())])
def test_scopes_as_sql_and_as_columns(spark, folder, ids):
    frame = spark.createDataFrame(SCOPES, "chunk_id string, author string, file_path string")
    tags = predicates.Tags({})
    assert {x for (x,) in found(frame.where(tags.sql(folder)), "chunk_id")} == ids
    assert {x for (x,) in found(frame.where(tags.column(folder)), "chunk_id")} == ids


def test_tags():
    tags = predicates.Tags({"a": ("x", "y"), "b": ("y", "z"), "none": ()})
    assert tags.folders(["a", "b"]) == ("x", "y", "z") and tags.sql() is None
    with pytest.raises(predicates.UnknownTagError, match="a, b, none"):
        tags.folders(["q"])
    with pytest.raises(predicates.EmptyTagError):
        tags.folders(["none"])
    for blank in ({"folder": " "}, {"condition": ""}):
        with pytest.raises(ConfigurationError):
            tags.sql(**blank)


def test_search_pipeline(spark, chunks):
    one = ask(spark)
    rows = search(chunks, one, Options(limit=2, context_window=1)).orderBy("rank").collect()
    assert rows[0]["chunk_id"] == "c1" and len(rows) == 2 and rows[0]["expanded_context"].startswith("Neural") and "vector" not in rows[0]
    assert search(chunks, one, Options(mode="lexical_only")).count() == 1
    assert search(chunks, one, Options(mode="dense_only", rollup=True)).count() == 2
    assert search(chunks, one, Options(fusion="linear", mmr_diversity=0.5, include_vector=True)).columns.count("vector") == 1
    assert search(chunks, ask(spark, "  "), Options()).count() == 0
    assert search(chunks.limit(0), one, Options()).count() == 0
    assert search(chunks, one, Options(limit=1), rerank=lambda d: d.withColumn("rank", F.col("rank") + 1)).count() == 0
    assert Options(limit=20).depth == 80 and Options(limit=1).depth == 30 and Options(fetch_k=5).depth == 5
    with pytest.raises(ConfigurationError):
        Options(mode="x")


def test_pooling_and_dense_stages(spark):
    row0 = [(1, 2, -1), (3, 4, 1), (0.5, 1, 2), (-0.5, 5, 6)]
    row1 = [(2, -3, 0.5), (4, 1, 1.5)]
    rows = [(k, i, True, [float(x) for x in v]) for k, vs in enumerate((row0, row1)) for i, v in enumerate(vs)] + [(0, 9, False, [9.0] * 3), (1, 9, False, [9.0] * 3)]
    t = spark.createDataFrame(rows, "row_id int, token_pos int, attended boolean, embedding array<float>")
    pooled = {r["row_id"]: list(r["vector"]) for r in V.pool(t, "row_id").collect()}
    assert pooled == {0: [1, 3, 2], 1: [3, -1, 1]}
    assert {r["row_id"]: list(r["vector"]) for r in V.pool(t, "row_id", "cls").collect()} == {0: [1, 2, -1], 1: [2, -3, 0.5]}
    one = V.DenseStage(np.diag([1.0, 2.0, 1.0]), np.array([1.0, 1.0, 0.0]))
    two = V.DenseStage(np.array([[0, 1, 0], [0, 0, 1], [1, 0, 0]], float))
    out = {r["row_id"]: list(r["v"]) for r in V.pool(t, "row_id").select("row_id", V.dense(F.col("vector"), [one, two]).alias("v")).collect()}
    assert out == {0: [7, 2, 2], 1: [-1, 1, 4]}
    unit = V.finalize(t, "row_id", "mean", [one, two]).collect()
    assert all(abs(sum(x * x for x in r["vector"]) - 1) < 1e-9 for r in unit)
    with pytest.raises(ConfigurationError):
        V.DenseStage(np.eye(2), None, "gelu")
    with pytest.raises(ConfigurationError):
        V.stages_from_arrays({"a.weight": np.eye(2), "b.weight": np.eye(2)}, ["a"])
    with pytest.raises(Exception, match="normalised"):
        spark.createDataFrame([([0.0, 0.0],)], "v array<double>").select(V.l2_normalise(F.col("v"))).collect()


def test_energy_latency_and_memory(spark):
    s = spark.createDataFrame([("r", 10.0, 2.0), ("r", 10.5, 6.0), ("r", 11.5, None), ("r", 12.0, 4.0)], "run_id string, at_seconds double, watts double")
    e = evaluation.energy(s, end=F.lit(13.0)).first()
    assert (e["joules"], e["measured_s"], e["unmeasured_s"], e["reported"], e["missed"]) == (11.0, 2.5, 0.5, 3, 1)
    assert spark.range(1).select(evaluation.joules_per_thousand(F.lit(11.0), F.lit(250)).alias("j")).first()["j"] == 44.0
    for values, median, p95 in (([*range(1, 11)], 5.5, 10.0), ([4, 1, 3, 2], 2.5, 4.0)):
        f = spark.createDataFrame([("k", float(v)) for v in values], "k string, v double")
        r = evaluation.latency(f, ["k"], "v").first()
        assert (r["median"], r["percentile"]) == (median, p95)
    m = evaluation.memory(spark.createDataFrame([("r", 1.0, 5), ("r", 2.0, 9), ("r", 3.0, 7)], "run_id string, at_seconds double, bytes long")).first()
    assert (m["peak"], m["baseline"]) == (9, 5)


def test_recall_and_policies(spark):
    top = spark.createDataFrame([(1, "a", 0), (1, "b", 1), (1, "c", 2)], "query_id int, chunk_id string, rank int")
    rel = spark.createDataFrame([(1, "a"), (1, "c"), (2, "z")], "query_id int, chunk_id string")
    assert dict(found(evaluation.recall_at_k(top, rel, 2), "query_id", "recall")) == {1: 0.5, 2: 0.0}
    assert evaluation.mean_recall(evaluation.recall_at_k(top, rel, 2)).first()[0] == 0.25
    assert found(evaluation.unknown_judgements(rel, top), "chunk_id") == [("z",)]
    c = spark.createDataFrame([("p/x#1", "p", "x", "good"), ("q/x#1", "p", "x", "bad id"), ("p/x#2", "p", "x", " spaced "), ("p/x#3", "p", "x", "y" * 501)], "chunk_id string, publication string, article_id string, text string")
    rules = {r for (r,) in found(evaluation.policy_breaches(c), "rule")}
    assert rules == {"id_prefix", "spaced", "too_long", "per_article"}


def test_stride_positions(spark):
    sizes, wanted = range(1, 41), (1, 3, 7, 12)
    frame = spark.createDataFrame([(n, w, p) for n in sizes for w in wanted for p in range(n)], "n long, w long, p long")
    got = {tuple(r) for r in frame.where(sampling.at_stride(F.col("p"), F.col("n"), F.col("w"))).collect()}
    assert got == {(n, w, p) for n in sizes for w in wanted for p in (range(n) if n <= w else {n * (2 * i + 1) // (2 * w) for i in range(w)})}


def test_sampling(spark):
    f = spark.createDataFrame([("g", i) for i in range(10)], "g string, i int")
    assert sorted(x for (x,) in found(sampling.stride_sample(f, "g", ["i"], 3), "i")) == [1, 5, 8]
    sizes = spark.createDataFrame([("big", 100), ("mid", 30), ("small", 5)], "g string, n long")
    assert dict(found(sampling.allocate(sizes, "g", "n", 40, 8), "g", "wanted")) == {"big": 26, "mid": 9, "small": 5}
    k = spark.createDataFrame([("x", "A"), ("x", "A"), ("y", "A"), ("y", "B")], "k string, g string")
    assert sampling.only_in_one(k, F.col("k"), "g").count() == 2


def test_repeats_across_sources_are_of_whole_texts(spark, tmp_path):
    head = "licence " * 10
    rows = [(1, "a", head + "one"), (2, "b", head + "two"), (3, "a", "Same, text!"), (4, "b", "same  text"), (5, "a", "twice"), (6, "a", "twice"), (7, "a", None)]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(found(queries.QUERIES["repeated_across_sources_whole"](spark, str(tmp_path)), "doc_id")) == [(1,), (2,), (5,), (6,)]


def test_whole_table_queries_work_on_numbers_long_and_short_texts(spark, tmp_path):
    texts = {1: "a 1 (1) 12 x1 1. b", 2: "7 8", 3: "plain words", 4: "", 5: None, 6: "word " * 200, 7: "x" * 300 + ". " + "y " * 200, 8: "z" * 500}
    rows = [(i, t, "en", "s" if i < 7 else "t", None if t is None else len(t)) for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    run = lambda name, *columns: found(queries.QUERIES[name](spark, str(tmp_path)), *columns)
    kept = dict(run("numeric_token_filter_all", "doc_id", "kept"))
    assert {i: kept[i] for i in (1, 2, 3, 4, 5)} == {1: "a 1 (1) b $1,000 [4.0]", 2: "$1,000 [4.0]", 3: "plain words $1,000 [4.0]", 4: " $1,000 [4.0]", 5: None} and len(kept) == 8
    capped = dict(run("excerpt_cap_all", "doc_id", "t"))
    assert capped == texts | {6: ("word " * 100).strip(), 7: "x" * 300 + "."}
    assert sorted(run("folder_rows_all", "folder", "hits", "documents")) == [("s", 6, 6), ("t", 2, 2)]
    order = sorted((position, chunk) for chunk, position in run("group_by_folder_order_all", "chunk_id", "position"))
    assert order == list(enumerate([1, 2, 3, 4, 5, 6, 7, 8]))
    assert sorted(run("document_position_all", "chunk_id", "document_index", "document_total")) == [(i, i, 6) for i in range(1, 7)] + [(7, 1, 2), (8, 2, 2)]


def test_every_fiftieth_row_is_a_query(spark, tmp_path):
    documents = [(i, "alpha" if i == 100 else "beta" if i == 200 else "gamma", "en", "s", 5) for i in range(0, 250, 10)]
    spark.createDataFrame(documents, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, [1.0, float(i)], i) for i in range(0, 250, 10)], "vec_id long, embedding array<float>, label long").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([(0, "alpha"), (7, "gamma"), (50, "beta"), (100, "alpha beta")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(100, 1), (200, 1), (110, 0)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    run = lambda name, *columns: sorted(found(queries.QUERIES[name](spark, str(tmp_path)), *columns))
    nearest = run("dense_topk_cosine_all", "query_id", "dense_rank")
    assert nearest == [(q, k) for q in (0, 50, 100, 150, 200) for k in range(10)]
    assert run("lexical_bm25_all", "query_id", "chunk_id") == [(0, 100), (50, 200), (100, 100), (100, 200)]
    assert run("recall_at_k_all", "query_id", "recall") == [(0, 0.5), (50, 0.5), (100, 1.0)]
