"""Measures: recall, document frequencies, latencies, energy, and the composition of a corpus."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import subject_terms
from . import ranks


def recall_at_k(results: DataFrame, relevant: DataFrame, k: int, id_column: str = "chunk_id") -> DataFrame:
    """query_id, recall: the share of each query's relevant ids among its first k results."""
    top = results.where(F.col("rank") < k).select("query_id", id_column).distinct().withColumn("_hit", F.lit(1))
    both = relevant.select("query_id", id_column).distinct().join(top, ["query_id", id_column], "left")
    return both.groupBy("query_id").agg((F.count("_hit") / F.count("*")).alias("recall"))


def recall_of_shared(results: DataFrame, queries: DataFrame, relevant: DataFrame, k: int, id_column: str = "chunk_id") -> DataFrame:
    """query_id, recall where all queries have the same relevant ids: these are counted once, and meet the first k results only."""
    judged = relevant.select(id_column).distinct()
    total = judged.count()
    if not total:
        return results.select("query_id", F.lit(0.0).alias("recall")).where("false")
    top = results.where(F.col("rank") < k).select("query_id", id_column).distinct().join(judged, id_column, "left_semi")
    hits = top.groupBy("query_id").agg(F.count("*").alias("_hits"))
    return queries.select("query_id").distinct().join(hits, "query_id", "left").select("query_id", (F.coalesce("_hits", F.lit(0)) / total).alias("recall"))


def mean_recall(recalls: DataFrame) -> DataFrame:
    return recalls.agg(F.avg("recall").alias("mean_recall"))


def term_idf(chunks: DataFrame, text: str = "text") -> DataFrame:
    """term, df, idf = ln(1 + N / (1 + df)) of the subject terms."""
    n = chunks.agg(F.count("*").alias("n"))
    df = chunks.select(F.explode(subject_terms(F.col(text))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return df.join(F.broadcast(n)).select("term", "df", F.log(1 + F.col("n") / (1 + F.col("df"))).alias("idf"))


def idf_rank(chunks: DataFrame, queries: DataFrame, k: int, id_column: str = "chunk_id") -> DataFrame:
    """The k chunks of each query with the largest sum of common terms' idf."""
    weights = term_idf(chunks)
    asked = queries.select("query_id", F.explode(subject_terms(F.col("query"))).alias("term"))
    held = chunks.select(id_column, F.explode(subject_terms(F.col("text"))).alias("term"))
    scored = held.join(asked, "term").join(weights.select("term", "idf"), "term").groupBy("query_id", id_column).agg(F.sum("idf").alias("score"))
    by = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), id_column)
    return scored.withColumn("rank", F.row_number().over(by) - 1).where(F.col("rank") < k)


def latency(frame: DataFrame, by: list[str], value: str, fraction: float = 0.95) -> DataFrame:
    """by, n, median (the mean of the middle two) and nearest-rank percentile; a group without values has n = 0 and nulls.

    Both are found by histograms, so a group's values are never held together.
    """
    groups = frame.select(*by).distinct()
    found = ranks.median_and_percentile(frame, by, value, fraction).withColumnsRenamed({c: f"_g{i}" for i, c in enumerate(by)})
    same = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(by)))
    return groups.join(found, same, "left").select(*by, F.coalesce("n", F.lit(0)).alias("n"), "median", "percentile")


def throughput(n: Column, seconds: Column) -> Column:
    """n / seconds, null where no time passed."""
    return F.when(seconds > 0, n / seconds)


def energy(samples: DataFrame, run: str = "run_id", at: str = "at_seconds", watts: str = "watts", end: Column | None = None) -> DataFrame:
    """run, joules, measured_s, unmeasured_s, reported, missed: the integral of power by left-hand rectangles.

    A sample holds until the next one, or until `end`; the time of a sample without a reading is unmeasured.
    """
    by = Window.partitionBy(run).orderBy(at)
    until = F.coalesce(F.lead(at).over(by), end) if end is not None else F.lead(at).over(by)
    rows = samples.withColumn("_span", F.coalesce(until - F.col(at), F.lit(0.0)))
    return rows.groupBy(run).agg(
        F.coalesce(F.sum(F.col(watts) * F.col("_span")), F.lit(0.0)).alias("joules"),
        F.sum(F.when(F.col(watts).isNotNull(), F.col("_span")).otherwise(0.0)).alias("measured_s"),
        F.sum(F.when(F.col(watts).isNull(), F.col("_span")).otherwise(0.0)).alias("unmeasured_s"),
        F.count(watts).alias("reported"),
        F.count_if(F.col(watts).isNull()).alias("missed"),
    )


def joules_per_thousand(joules: Column, inputs: Column) -> Column:
    return F.when(inputs > 0, joules * 1000 / inputs)


def memory(samples: DataFrame, run: str = "run_id", at: str = "at_seconds", value: str = "bytes") -> DataFrame:
    """peak and baseline (the first sample)."""
    return samples.groupBy(run).agg(F.max(value).alias("peak"), F.min_by(value, at).alias("baseline"))


def matrix(timings: DataFrame, power: DataFrame, memory_: DataFrame, recalls: DataFrame) -> DataFrame:
    """One row a model: its latencies, throughput, energy for a thousand inputs, memory and mean recall.

    timings: model, inputs, seconds of each call; power: model, at_seconds, watts; memory_: model,
    at_seconds, bytes; recalls: model, recall. Models without a measure of a kind have nulls there.
    """
    calls = latency(timings, ["model"], "seconds").withColumnsRenamed({"n": "calls", "percentile": "p95"})
    totals = timings.groupBy("model").agg(F.sum("inputs").alias("inputs"), F.sum("seconds").alias("_seconds"))
    out = calls.join(totals, "model").withColumn("per_second", throughput(F.col("inputs"), F.col("_seconds"))).drop("_seconds")
    used = energy(power, "model").select("model", "joules", "unmeasured_s")
    out = out.join(used, "model", "left").withColumn("joules_per_thousand", joules_per_thousand(F.col("joules"), F.col("inputs"))).drop("joules")
    out = out.join(memory(memory_, "model"), "model", "left")
    return out.join(recalls.groupBy("model").agg(F.avg("recall").alias("mean_recall")), "model", "left")


def composition(chunks: DataFrame, group: str, length: Column) -> DataFrame:
    """One row for each group: chunks, and the least, greatest, mean and total length."""
    return chunks.groupBy(group).agg(F.count("*").alias("chunks"), F.min(length).alias("least"), F.max(length).alias("greatest"), F.avg(length).alias("mean"), F.sum(length).alias("total"))


def judgements(relevant: DataFrame, id_column: str = "chunk_id") -> DataFrame:
    """queries, judgements, least, greatest, mean: how many relevant ids the queries have; one row."""
    each = relevant.select("query_id", id_column).distinct().groupBy("query_id").agg(F.count("*").alias("n"))
    return each.agg(F.count("*").alias("queries"), F.sum("n").alias("judgements"), F.min("n").alias("least"), F.max("n").alias("greatest"), F.avg("n").alias("mean"))


def policy_breaches(chunks: DataFrame, most_chars: int = 500, per_article: int = 2) -> DataFrame:
    """rule, chunk_id of what a benchmark corpus may not hold; no rows if all is well."""
    outside = ~F.startswith(F.col("chunk_id"), F.concat_ws("#", F.concat_ws("/", "publication", "article_id"), F.lit("")))
    rules = {"id_prefix": outside, "too_long": F.length("text") > most_chars, "spaced": F.col("text") != F.trim("text"), "empty": F.col("text") == ""}
    one = chunks.select("chunk_id", F.explode(F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in rules.items())))).alias("rule"))
    many = chunks.groupBy("publication", "article_id").agg(F.count("*").alias("n"), F.max("chunk_id").alias("chunk_id")).where(F.col("n") > per_article).select("chunk_id", F.lit("per_article").alias("rule"))
    twice = chunks.groupBy("chunk_id").count().where("count > 1").select("chunk_id", F.lit("duplicate_id").alias("rule"))
    return one.unionByName(many).unionByName(twice).select("rule", "chunk_id")


def unknown_judgements(relevant: DataFrame, chunks: DataFrame, id_column: str = "chunk_id") -> DataFrame:
    return relevant.join(chunks.select(id_column), id_column, "left_anti")


def pair_similarity(chunks: DataFrame, group: str, id_column: str = "chunk_id") -> DataFrame:
    """group, a, b, overlap: common subject terms of the pairs of one article, by their common terms, not by all pairs."""
    held = chunks.select(group, id_column, F.explode(subject_terms(F.col("text"))).alias("term"))
    other = held.select(group, "term", F.col(id_column).alias("b"))
    return held.withColumnRenamed(id_column, "a").join(other, [group, "term"]).where("a < b").groupBy(group, "a", "b").agg(F.count("*").alias("overlap"))
