"""Descriptions of images: gates, then the cache by a join, then a describer for the rest only."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import ConfigurationError
from ..sources import extract

MIN_PIXELS = 200
#: Calls to a describer that one task has in flight.
CONCURRENCY = 4
Describe = Callable[[bytes], str]


def below_threshold(width: Column, height: Column, least: int = MIN_PIXELS) -> Column:
    return F.least(width, height) < least


def resolve(images: DataFrame, cache: DataFrame, describe: Describe | None, model_id: str = "", prompt_version: str = "", least: int = MIN_PIXELS, concurrency: int = CONCURRENCY) -> DataFrame:
    """The images (image_sha256, width, height, chart_text, content) with `outcome` and `text`, in the order of the gates.

    Too small ones are left out; charts speak for themselves; then what the cache knows; then the
    describer is asked, once for each distinct image. Its failures are outcomes, not errors. A task
    has at most `concurrency` calls in flight, and gives their results in the order of its images.
    """
    if concurrency < 1:
        raise ConfigurationError("a describer needs a call in flight")
    known = cache.where((F.col("model_id") == model_id) & (F.col("prompt_version") == prompt_version)).select("image_sha256", F.col("text").alias("_known")).dropDuplicates(["image_sha256"])
    rows = images.join(known, "image_sha256", "left")
    gate = F.when(below_threshold(F.col("width"), F.col("height"), least), "below_threshold").when(F.col("chart_text").isNotNull(), "chart").when(F.col("_known").isNotNull(), "cached").when(F.lit(describe is None), "vision_unavailable").otherwise("described")
    rows = rows.withColumn("_gate", gate)

    @F.pandas_udf("struct<text:string,error:string>")
    def ask(contents: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        def one(content: bytes) -> tuple[str | None, str | None]:
            try:
                return describe(bytes(content)), None
            except Exception as e:  # a describer's failure is a result
                return None, f"{type(e).__name__}: {e}"

        with ThreadPoolExecutor(concurrency) as calls:
            for batch in contents:
                yield pd.DataFrame(list(calls.map(one, batch)), columns=["text", "error"])

    asked = rows.where("_gate = 'described'").dropDuplicates(["image_sha256"]).select("image_sha256", ask("content").alias("_said"))
    rows = rows.join(asked, "image_sha256", "left")
    text = F.when(F.col("_gate") == "chart", F.col("chart_text")).when(F.col("_gate") == "cached", F.col("_known")).when(F.col("_gate") == "described", F.col("_said.text"))
    outcome = F.when((F.col("_gate") == "described") & F.col("_said.error").isNotNull(), "vision_failed").otherwise(F.col("_gate"))
    return rows.withColumn("outcome", outcome).withColumn("text", text).drop("_known", "_gate", "_said")


def cache_rows(resolved: DataFrame, model_id: str, prompt_version: str) -> DataFrame:
    """New rows of the cache: one for each image that was described."""
    new = resolved.where("outcome = 'described'").dropDuplicates(["image_sha256"])
    return new.select("image_sha256", F.lit(model_id).alias("model_id"), F.lit(prompt_version).alias("prompt_version"), "text", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"))


def counters(resolved: DataFrame) -> DataFrame:
    """requests and cache_hits: one row."""
    return resolved.agg(F.count_if(F.col("outcome").isin("described", "vision_failed")).alias("requests"), F.count_if(F.col("outcome") == "cached").alias("cache_hits"))


def resolve_files(refs: DataFrame, files: DataFrame, cache: DataFrame, describe: Describe | None, model_id: str = "", prompt_version: str = "", least: int = MIN_PIXELS, concurrency: int = CONCURRENCY) -> DataFrame:
    """The image segments of files with `outcome`, `said` and `reason`; their bytes come from the archive's files.

    An image file is its own image; a Markdown reference names a file beside its document; a
    workbook's picture is a member of the workbook, and its chart speaks by its ranges. A
    reference without readable bytes is `unreadable`.
    """
    beside = F.concat(F.regexp_extract("relative_path", r"^(.*/)?[^/]*$", 1), F.col("image_ref"))
    beside = straightened(beside)
    inside = F.col("locator_type").isin("image_file", "sheet")
    rows = refs.withColumn("target", F.when(inside, F.col("relative_path")).otherwise(beside)).withColumn("chart_text", F.when((F.col("locator_type") == "sheet") & (F.col("image_ref") == "chart"), F.col("text")))
    held = files.select("root_id", F.col("relative_path").alias("target"), F.col("content").alias("_bytes"))
    rows = rows.join(held, ["root_id", "target"], "left")

    @F.pandas_udf("struct<content:binary,width:int,height:int,reason:string>")
    def look(content: pd.Series, ref: pd.Series, kind: pd.Series, chart: pd.Series) -> pd.DataFrame:
        out = []
        for bytes_, name, locator, text in zip(content, ref, kind, chart, strict=True):
            try:
                if text is not None:
                    out.append((text.encode(), least, least, None))
                    continue
                if bytes_ is None:
                    raise ValueError(f"the image {name} isn't in the archive")
                found = extract.member(bytes(bytes_), name) if locator == "sheet" else bytes(bytes_)
                out.append((found, *extract.image_size(found), None))
            except Exception as e:  # an image that can't be read is a result
                out.append((None, 0, 0, str(e)))
        return pd.DataFrame(out, columns=["content", "width", "height", "reason"])

    rows = rows.withColumn("_look", look("_bytes", "image_ref", "locator_type", "chart_text")).select(*(c for c in rows.columns if c not in ("_bytes", "text", "target")), "_look.*")
    rows = rows.withColumn("image_sha256", F.sha2("content", 256))
    seen = resolve(rows.where("reason IS NULL"), cache, describe, model_id, prompt_version, least, concurrency)
    unread = rows.where("reason IS NOT NULL").withColumn("outcome", F.lit("unreadable")).withColumn("text", F.lit(None).cast("string"))
    return seen.unionByName(unread).drop("content", "chart_text")


def straightened(path: Column) -> Column:
    """A relative path without `.` and with each `..` taken with the folder before it, however many there are."""
    climbed = lambda done: (F.size(done) > 0) & (F.element_at(done, -1) != "..")
    step = lambda done, part: F.when(part.isin("", "."), done).when((part == "..") & climbed(done), F.slice(done, 1, F.size(done) - 1)).otherwise(F.concat(done, F.array(part)))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def figures(seen: DataFrame, model_id: str, prompt_version: str) -> DataFrame:
    """What was said of images as segments, where the images stood."""
    said = seen.where("text IS NOT NULL").withColumn("kind", F.lit("figure"))
    origin = F.to_json(F.struct(F.lit(prompt_version).alias("prompt_version"), F.lit(model_id).alias("vision_model")))
    return said.withColumn("provenance_json", origin).drop("outcome", "reason", "width", "height", "image_sha256")


def omissions(seen: DataFrame) -> DataFrame:
    """Images that say nothing, and why."""
    size = F.concat(F.lit("the image has "), "width", F.lit(" x "), "height", F.lit(" pixels"))
    reason = F.coalesce("reason", F.when(F.col("outcome") == "below_threshold", size).when(F.col("outcome") == "vision_unavailable", "there is no describer").otherwise("the describer failed"))
    missing = F.when(F.col("outcome") == "vision_unavailable", "vision")
    return seen.where("text IS NULL").select(F.col("outcome").alias("category"), F.concat_ws("/", "root_id", "relative_path").alias("path"), reason.alias("reason"), missing.alias("missing_capability"))
