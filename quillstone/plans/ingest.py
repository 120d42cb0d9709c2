"""One run of ingestion: discover, classify, extract what changed, chunk it, and commit the state."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..schema import FILE_STATE, OMISSION_ROWS, REGISTRY, VISION_CACHE, IngestParams, content_hash
from ..sources import discover, extract
from ..sources.scratch import written
from ..sources.store import Bundle, upserted
from . import sync, vision
from .chunk import Tokens, chunk_segments


#: The ids that the last run removed.
REMOVED = StructType([f for f in REGISTRY if f.name != "record_json"])


@dataclass
class Report:
    """What a run found: chunk rows, ids that went, omissions, and counts of files by status."""

    records: DataFrame
    removed: DataFrame
    omissions: DataFrame
    files: dict[str, int]
    vision_requests: int = 0
    vision_cache_hits: int = 0

    def omission_counts(self) -> DataFrame:
        return discover.omission_counts(self.omissions)

    def render(self) -> str:
        lines = [f"files: {sum(self.files.values())}", *(f"  {k}: {self.files[k]}" for k in sorted(self.files))]
        return "\n".join([*lines, *(f"omitted, {r[0]}: {r[1]}" for r in self.omission_counts().orderBy("category").collect())])


class State:
    """The state tables of ingestion in one folder, committed together."""

    def __init__(self, spark: SparkSession, folder: str):
        self.tables = Bundle(spark, folder, {"file_state": FILE_STATE, "chunk_registry": REGISTRY, "removed": REMOVED, "vision_cache": VISION_CACHE})

    def drop(self) -> None:
        self.tables.drop()


def run(spark: SparkSession, roots: Sequence[str], state: State, params: IngestParams | None = None, include: Sequence[str] = (), exclude: Sequence[str] = (), tokens: Tokens | None = None, describe: vision.Describe | None = None) -> Report:
    """Only new and changed files are read beyond their bytes' hash; the state is committed once, at the end.

    Ids that a changed file no longer makes are removed too. A file that fails keeps its last good
    chunks, and so do files of a root that can't be reached. Images become figures by the gates
    of `vision.resolve`; what they can't be is an omission.
    """
    params, run_id = params or IngestParams(), uuid.uuid4().hex
    keys = ["root_id", "relative_path"]
    found, omissions = discover.discover(spark, roots, include, exclude)
    found = found.withColumn("route", discover.route(F.col("relative_path"), F.col("content"))).withColumn("content_hash", content_hash("content")).withColumn("params_fingerprint", F.lit(params.fingerprint()))
    known, registry, cache = (state.tables.read(name) for name in ("file_state", "chunk_registry", "vision_cache"))
    marked = sync.classify(found, known).persist()
    todo = marked.where("status <> 'unchanged' AND route IS NOT NULL").withColumn("file_hash", F.col("content_hash"))
    extracted = extract.extract(todo).persist()
    seen = vision.resolve_files(extract.images(extracted), marked, cache, describe, params.vision_model, params.prompt_version, params.min_image_pixels).persist()
    omissions = omissions.unionByName(discover.unsupported(marked.withColumn("path", F.concat_ws("/", *keys)))).unionByName(extract.omissions(extracted)).unionByName(vision.omissions(seen))
    failed = extracted.where("omission = 'failed'").select(*keys).distinct()
    records = chunk_segments(extract.segments(extracted).unionByName(vision.figures(seen, params.vision_model, params.prompt_version)), params, tokens)
    records = records.withColumn("record_json", F.to_json(F.struct(*records.columns))).persist()
    good = marked.where("route IS NOT NULL").join(failed, keys, "left_anti")
    unreachable = F.col("root_id").isin(*[r.rstrip("/") for r in roots if r not in discover.check_roots(roots)[0]])
    gone = sync.gone(known.where(~unreachable), marked, registry, failed)
    redone = registry.join(good.where("status <> 'unchanged'").select(*keys), keys, "left_semi").join(records.select("chunk_id"), "chunk_id", "left_anti").select("chunk_id", *keys)
    removed = gone.unionByName(redone)
    counts = {r[0]: r[1] for r in marked.groupBy("status").count().collect()}
    kept = registry.join(removed.select("chunk_id"), "chunk_id", "left_anti")
    absent = known.where(~unreachable).select(*keys).join(marked.select(*keys), keys, "left_anti")
    stamped = good.select(*keys, "content_hash", "params_fingerprint", "status", F.lit(run_id).alias("last_seen_run"))
    state.tables.commit({
        "removed": removed,
        "chunk_registry": upserted(kept, records.select("chunk_id", *keys, "record_json")),
        "file_state": upserted(known.join(absent, keys, "left_anti"), stamped, keys),
        "vision_cache": upserted(cache, vision.cache_rows(seen, params.vision_model, params.prompt_version), ["image_sha256", "model_id", "prompt_version"]),
    })
    everything = state.tables.read("chunk_registry").select(F.from_json("record_json", records.drop("record_json").schema).alias("r")).select("r.*")
    counted = vision.counters(seen).first()
    omissions = written(omissions)  # before what it comes from is let go
    for frame in (marked, extracted, seen, records):
        frame.unpersist()
    return Report(everything, state.tables.read("removed"), omissions, counts, counted["requests"], counted["cache_hits"])


def records_of(registry: DataFrame, root_id: str, relative_path: str) -> DataFrame:
    """The records of one file, in their order in it."""
    mine = registry.where((F.col("root_id") == root_id) & (F.col("relative_path") == relative_path))
    return mine.orderBy(F.get_json_object("record_json", "$.chunk_index").cast("long"), "chunk_id")
