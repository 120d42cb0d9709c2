"""Sinks for people and programs: JSON and text of results and summaries.

The shapes are built by Spark; only the rows that are shown (a query's limit) reach the driver.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import grouping
from ..operators.predicates import Tags
from .sync import Summary

RULER = 80
#: The keys of a result, in order.
RESULT_KEYS = ("folder", "tags", "document", "document_index", "document_total", "file_path", "source_path", "title", "chunk_id", "chunk_index", "chunk_kind", "headings", "locator_type", "locator", "locator_label", "score", "text", "expanded_context", "token_count", "dense_distance", "dense_rank", "lexical_score", "lexical_rank", "breadcrumb")
#: What a result may lack, and its type.
OPTIONAL = {"title": "string", "author": "string", "headings": "array<string>", "locator_type": "string", "locator_json": "string", "expanded_context": "string", "token_count": "long", "dense_distance": "double", "dense_rank": "int", "lexical_score": "double", "lexical_rank": "int", "chunk_kind": "string", "chunk_index": "long"}


def placed(results: DataFrame, archive_root: str | None = None, tags: Tags | None = None, group_by_folder: bool = False) -> DataFrame:
    """Results with folder, tags, position, document, document_index, document_total, locator_label and breadcrumb."""
    rows = results
    for name, kind in OPTIONAL.items():
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast(kind))
    rows = rows.withColumn("folder", X.folder_of(F.col("file_path"), F.col("author"), archive_root))
    rows = grouping.grouped_order(rows) if group_by_folder else rows.withColumn("position", F.col("rank"))
    rows = grouping.document_places(rows)
    rows = rows.withColumn("tags", tags.tags_of("folder") if tags else F.array().cast("array<string>")).withColumn("document", X.document_name(F.col("file_path"))).withColumn("locator_label", X.locator_label(F.col("locator_type"), F.col("locator_json")))
    return rows.withColumn("breadcrumb", X.breadcrumb(F.col("folder"), F.col("document_index"), F.col("document_total"), F.col("document"), F.col("chunk_index"), F.col("locator_label")))


def payloads(rows: DataFrame) -> DataFrame:
    """query_id, position, payload: each result as JSON with `RESULT_KEYS`; texts are verbatim."""
    shown = rows.withColumn("source_path", F.col("file_path")).withColumn("file_path", X.normalised_path(F.col("file_path"))).withColumn("locator", F.try_parse_json("locator_json"))
    return shown.select("query_id", "position", F.to_json(F.struct(*RESULT_KEYS), {"ignoreNullFields": "false"}).alias("payload"))


def search_json(rows: DataFrame, query: str, mode: str, provider: str, grouped: bool = False, total: int | None = None, elapsed: float | None = None, indent: int | None = 2) -> str:
    folders = grouping.folder_rows(rows).join(rows.groupBy("folder").agg(F.min("position").alias("first"), F.first("tags").alias("tags")), "folder").orderBy("first").collect()
    results = [json.loads(r["payload"]) for r in payloads(rows).orderBy("position").collect()]
    head = {"query": query, "mode": mode, "provider": provider, "grouped": grouped, "total_candidates": total, "elapsed_seconds": elapsed}
    listed = [{"folder": f["folder"], "tags": list(f["tags"]), "hits": f["hits"], "documents": f["documents"]} for f in folders]
    return json.dumps(head | {"folders": listed, "results": results}, ensure_ascii=False, indent=indent)


#: The terminal's codes for the styles of a result.
STYLES = {"reset": "\x1b[0m", "bold": "\x1b[1m", "dim": "\x1b[2m", "cyan": "\x1b[36m", "green": "\x1b[32m", "magenta": "\x1b[35m"}


def styled(text: str, style: str, color: bool) -> str:
    return f"{STYLES[style]}{text}{STYLES['reset']}" if color else text


def may_color(asked_not_to: bool, terminal: bool, environment: Mapping[str, str]) -> bool:
    """Styles are for a terminal only, unless the user or NO_COLOR (if set to anything) says no."""
    return terminal and not asked_not_to and not environment.get("NO_COLOR")


def search_text(rows: DataFrame, query: str, mode: str, provider: str, grouped: bool = False, color: bool = False) -> str:
    """Results for a terminal; escapes that come from the archive are taken out, so only these styles are there."""
    clean = {c: X.strip_ansi(F.col(c)) for c in ("folder", "breadcrumb")}
    shown = rows.withColumns(clean | {"snippet": X.snippet(F.col("text")), "context": X.snippet(F.col("expanded_context"), 400)}).orderBy("position").collect()
    head = [f"{styled('Query:', 'bold', color)} {query}", f"Mode: {mode} | Provider: {provider}"]
    if not shown:
        return "\n".join([*head, "", "No results."])
    lines = [*head, f"Results: {len(shown)} in {len({r['folder'] for r in shown})} folders", styled("=" * RULER, "dim", color)]
    folder = None
    for r in shown:
        if grouped and r["folder"] != folder:
            folder = r["folder"]
            tags = " " + styled(f"[{', '.join(r['tags'])}]", "magenta", color) if r["tags"] else ""
            lines += [styled(f"Folder: {folder}", "cyan", color) + tags, styled("-" * RULER, "dim", color)]
        lines += [f"{r['breadcrumb']} {styled(f'[Score: {r["score"]:.3f}]', 'green', color)}", f'  "{r["snippet"]}"']
        if r["context"]:
            lines.append(f"  Context: {r['context']}")
        lines.append("")
    return "\n".join(lines).rstrip()


def summary(s: Summary, files: dict[str, int], omissions: Sequence[tuple[str, int]], as_json: bool = False) -> str:
    payload = {"files": dict(sorted(files.items())), "chunks": {"added": s.added, "updated": s.updated, "unchanged": s.unchanged, "deleted": s.deleted, "total": s.total}, "documents": s.documents, "omissions": dict(omissions)}
    if as_json:
        return json.dumps(payload, ensure_ascii=False, indent=2)
    parts = [f"Files: {', '.join(f'{v} {k}' for k, v in payload['files'].items()) or 'none'}", f"Chunks: {', '.join(f'{v} {k}' for k, v in payload['chunks'].items())}", f"Documents: {s.documents}"]
    return "\n".join(parts + [f"Omitted: {v} {k}" for k, v in payload["omissions"].items()])
