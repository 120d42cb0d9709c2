"""Reports from what was observed while a run worked, and a describer's bounded calls."""

from __future__ import annotations

import itertools
import time

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quillstone.plans import report, vision
from quillstone.schema import ConfigurationError


@pytest.fixture
def records(spark):
    return spark.range(100, numPartitions=3).selectExpr("id AS doc_id", "repeat('x', cast(id AS int)) AS text")


def test_numbers_of_a_run_are_those_of_its_rows(spark, records, tmp_path):
    steps, ends, ticks = [], [], itertools.count()
    metrics = {"long": (F.length("text") > 50).cast("long"), "characters": F.length("text").cast("long")}
    done = report.run(records, lambda part: part.withColumn("n", F.length("text")), str(tmp_path / "out"), "embedding", 5, metrics=metrics, on_progress=lambda *at: steps.append(at), on_finish=ends.append, clock=lambda: float(next(ticks)))
    assert ends == [done] and (done.completed, done.total, done.reason, done.seconds, done.per_second) == (100, 100, None, 1.0, 100.0)
    assert done.metrics == {"long": 49, "characters": 4950} and sum(done.batches) == 100 and len(done.batches) == 5
    assert steps == [(sum(done.batches[: k + 1]), 100) for k in range(5)]
    assert spark.read.parquet(str(tmp_path / "out")).agg(F.count("*"), F.sum("n")).first() == (100, 4950)
    assert done.text() == "embedding: 100 of 100 in 1.0 s, 100.0 a second, long 49, characters 4950"


def test_an_interrupted_run_reports_what_was_done_and_fails(spark, records, tmp_path):
    ends = []
    stop = lambda part: part.withColumn("text", F.when(F.col("doc_id") == 52, F.raise_error(F.lit("no more"))).otherwise(F.col("text")))
    with pytest.raises(PySparkException):
        report.run(records, stop, str(tmp_path / "out"), batches=10, batch=F.col("doc_id") % 10, metrics={"n": F.lit(1)}, on_finish=ends.append)
    (end,) = ends
    assert end.interrupted and "no more" in end.reason and "\n" not in end.reason
    assert (end.completed, end.total, end.batches, end.metrics) == (20, 100, (10, 10), {"n": 20})
    assert spark.read.parquet(str(tmp_path / "out")).count() == 20

    def broken(part):
        raise KeyError("gone")

    with pytest.raises(KeyError):
        report.run(records, broken, str(tmp_path / "none"), on_finish=ends.append)
    assert ends[-1].completed == 0 and ends[-1].reason == "KeyError: 'gone'"


def test_runs_of_nothing_and_bad_batches(records, tmp_path):
    done = report.run(records.where("false"), lambda part: part, str(tmp_path / "a"), batches=2, metrics={"n": F.lit(1)})
    assert (done.completed, done.total, done.metrics) == (0, 0, {"n": 0})
    with pytest.raises(ConfigurationError):
        report.run(records, lambda part: part, str(tmp_path / "b"), batches=0)
    with pytest.raises(ConfigurationError, match="90 records"):
        report.run(records, lambda part: part, str(tmp_path / "c"), batches=1, batch=F.col("doc_id") % 10)


def test_metrics_beside_an_action(records):
    rows, seen = report.observed(records, {"n": F.count("*"), "most": F.max(F.length("text"))}, lambda frame: frame.collect())
    assert len(rows) == 100 and seen == {"n": 100, "most": 99}


def test_a_describer_has_a_bounded_number_of_calls_in_flight(spark):
    rows = [(f"h{i}", 500, 500, None, bytes([i])) for i in range(12)]
    images = spark.createDataFrame(rows, "image_sha256 string, width int, height int, chart_text string, content binary").coalesce(1)
    cache = spark.createDataFrame([], "image_sha256 string, model_id string, prompt_version string, text string, created_at string")

    def describe(content: bytes) -> str:
        import threading as t

        t.current_thread()._busy = True
        time.sleep(0.05 * (1 + content[0] % 3))
        flight = [x for x in t.enumerate() if x.__dict__.get("_busy")]
        t.current_thread()._busy = False
        if content[0] == 5:
            raise ValueError("blurred")
        return f"{content[0]} {len(flight)}"

    for most in (1, 3):
        out = {r["image_sha256"]: (r["outcome"], r["text"]) for r in vision.resolve(images, cache, describe, "m", "1", concurrency=most).collect()}
        said = {k: tuple(map(int, t.split())) for k, (o, t) in out.items() if o == "described"}
        assert out["h5"] == ("vision_failed", None) and len(said) == 11
        assert all(k == f"h{n}" for k, (n, _) in said.items()), "each image has its own description"
        assert max(f for _, f in said.values()) <= most and (most == 1 or max(f for _, f in said.values()) > 1)
    with pytest.raises(ConfigurationError):
        vision.resolve(images, cache, describe, concurrency=0)


def test_paths_beside_a_document_at_any_depth(spark):
    cases = {"a/./b.png": "a/b.png", "a/b/../c.png": "a/c.png", "/".join("abcdefghijkl") + "/../" * 1 + "x": "/".join("abcdefghijk") + "/x", "/".join("abcdefghijklm") + "/.." * 11 + "/x": "a/b/x", "../x": "../x", "a/../../x": "../x", "x": "x", "./x": "x"}
    frame = spark.createDataFrame([(k,) for k in cases], "p string").select("p", vision.straightened(F.col("p")).alias("s"))
    assert {r["p"]: r["s"] for r in frame.collect()} == cases


def test_progress_of_a_run_that_fails_is_no_result(spark, tmp_path):
    """A text that can't be embedded ends the run, and isn't told as fewer steps."""
    from quillstone.indexes import run_progress

    spark.createDataFrame([(0, "a b"), (1, " "), (2, "c"), (3, "d")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    with pytest.raises(PySparkException):
        run_progress(spark, str(tmp_path))


def test_a_table_in_parts_is_one_file_of_the_root(spark, tmp_path):
    from quillstone.cases import walk_root

    for name in ("a", "b"):
        spark.range(4).repartition(2).write.parquet(str(tmp_path / f"{name}.parquet"))
    (tmp_path / "c.parquet").write_bytes(b"x")
    (tmp_path / "d.txt").write_bytes(b"x")
    assert sorted(map(tuple, walk_root(spark, str(tmp_path)).collect())) == [("a.parquet", ""), ("b.parquet", ""), ("c.parquet", "")]
