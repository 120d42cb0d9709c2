"""The pipeline's stages on a small corpus with planted cases."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillstone.llm import pipeline, suffix
from quillstone.llm._tables import written

from .test_operators import SHAPE, brute_classes, brute_repeats, coder, prose


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    r = random.Random(3)
    rows, labels = [], []
    for i in range(240):
        words = prose(r, 60).split()
        if i % 4 == 0:
            for k in range(2, 60, 8):
                words[k] = r.choice(("vilegrub", "scumworm", "dungwit"))
        rows.append((i, " ".join(words), "en", f"s{i % 3}", 0))
        labels.append((i, 1, int(i % 4 == 0)))
    base = rows[1][1].split()
    rows += [(500, rows[1][1], "en", "s1", 0), (501, " ".join([*base[:30], "other", *base[31:]]), "en", "s2", 0), (502, None, None, None, 0)]
    passage = prose(r, 70)
    rows += [(600 + k, f"{prose(r, 50)} {passage} {prose(r, 50)}", "en", "s0", 0) for k in range(3)]
    spark.createDataFrame(rows, SHAPE).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, folder))
        seen.append(docs)
        if name != "byte_bpe":
            assert docs.columns == columns
    assert len(seen) == 5
    ids = [{r[0] for r in d.select("doc_id").collect()} for d in seen]
    assert len([i for i in ids[0] if i < 240 and i % 4]) >= 178 and len([i for i in ids[0] if i < 240 and i % 4 == 0]) <= 10
    assert 1 in ids[1] and not {500, 501} & ids[1] and 502 in ids[1]
    texts = {r["doc_id"]: r["text"] for r in seen[2].collect()}
    assert ids[2] == ids[1] and all(500 < len(texts[600 + k]) < 900 for k in range(3))
    mixed = seen[3].groupBy("doc_id").count().collect()
    assert mixed and max(r["count"] for r in mixed) <= 2
    sample = seen[4].where("doc_id = 601").limit(1).collect()
    for r in sample:
        assert r["n_tokens"] == len(coder().encode_ordinary(texts[601])) and r["decoded_sha256"] == hashlib.sha256(texts[601].encode()).hexdigest()


def test_run(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 100


def test_stages_equal_brute_force(spark, folder):
    """Each stage on its own input, over a table with clashing columns, repeated rows and nulls."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    more = spark.createDataFrame([(601, docs.where("doc_id = 601").first()["text"], "en", "s0", 0), (None, "alone without an id", "en", None, 0), (7, "other text of an id", "en", "s1", 0), (503, "", "en", "s1", 0)], SHAPE)
    docs = docs.unionByName(more)
    for name in ("_row", "_key", "row", "node", "runs", "score", "starts", "tag"):
        docs = docs.withColumn(name, F.lit("clash"))
    text = lambda frame: sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["text"] or "") for r in frame.collect())
    kept = []
    for name, stage in pipeline.STAGES:
        before, docs = docs, written(stage(spark, docs, folder))
        if name != "byte_bpe":
            assert docs.columns == before.columns and docs.where("node <> 'clash' OR _row <> 'clash'").count() == 0
        kept.append((name, text(before), text(docs) if name != "byte_bpe" else docs.collect()))
    by_name = {name: (before, after) for name, before, after in kept}
    before, after = by_name["toxicity"]
    assert not set(after) - set(before) and (-1, "alone without an id") in after and (503, "") in after
    before, after = by_name["ngram_jaccard_join"]
    assert len(after) == len(set(brute_classes(before)[0])) and not set(after) - set(before)
    before, after = by_name["suffix_array_dedup"]
    left = {(d if d is not None else -1): n - gone for d, n, gone, *_ in brute_repeats([(d if d >= 0 else None, t) for d, t in before], suffix.LENGTH)}
    assert all(len(t.encode()) == left[d] for d, t in after if d != 7)
    before, after = by_name["source_mix"]
    assert not set(after) - set(before) and max(Counter(after).values()) <= 2
    before, after = by_name["byte_bpe"]
    assert sorted((r["n_tokens"], r["decoded_sha256"]) for r in after) == sorted((len(coder().encode_ordinary(t)), hashlib.sha256(t.encode()).hexdigest()) for _, t in before)


def test_stages_on_an_empty_table(spark, folder):
    docs = spark.createDataFrame([], SHAPE)
    for _, stage in pipeline.STAGES:
        docs = written(stage(spark, docs, folder))
        assert docs.count() == 0
