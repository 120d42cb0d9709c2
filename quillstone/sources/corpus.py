"""The benchmark corpus: strict JSON lines of chunks and judgements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluation
from ..schema import SchemaError

CHUNK_LINES = "chunk_id string, publication string, article_id string, article_title string, text string"
QUERY_LINES = "query_id string, text string, relevant_chunk_ids array<string>"


def read_lines(spark: SparkSession, path: str, shape: str) -> DataFrame:
    """The rows of a file of JSON lines; a line that isn't of this shape fails the read, as do nulls and blanks."""
    rows = spark.read.schema(shape).option("mode", "FAILFAST").json(path)
    checked = [F.when(F.col(f.name).isNull() | ((F.trim(f.name) == "") if f.dataType.simpleString() == "string" else (F.size(f.name) == 0)), F.raise_error(F.lit(f"{f.name} is missing or empty")).cast(f.dataType)).otherwise(F.col(f.name)).alias(f.name) for f in rows.schema]
    return rows.select(*checked)


def load(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(chunks, judgements as query_id, query, chunk_id), checked against the corpus's rules."""
    chunks, queries = read_lines(spark, f"{folder}/chunks.jsonl", CHUNK_LINES), read_lines(spark, f"{folder}/relevance.jsonl", QUERY_LINES)
    judged = queries.select("query_id", F.col("text").alias("query"), F.explode("relevant_chunk_ids").alias("chunk_id"))
    wrong = evaluation.policy_breaches(chunks).select(F.concat_ws(" ", "rule", "chunk_id").alias("what"))
    wrong = wrong.union(evaluation.unknown_judgements(judged, chunks).select(F.concat_ws(" ", F.lit("unknown"), "chunk_id"))).limit(5)
    if found := [r[0] for r in wrong.collect()]:
        raise SchemaError("the corpus breaks its rules: " + "; ".join(found))
    return chunks, judged
