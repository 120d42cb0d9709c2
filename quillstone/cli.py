"""Command line: index an archive, search it, show its state and tags."""

from __future__ import annotations

import argparse
import json
import os
import sys
import time
from collections.abc import Sequence

from .schema import CHUNKS, ConfigurationError, EngineError, IngestParams

OK, FAILED, MISSING = 0, 1, 2


def _positive(text: str) -> int:
    if not text.isdigit() or int(text) < 1:
        raise argparse.ArgumentTypeError("must be a positive number")
    return int(text)


def _natural(text: str) -> int:
    if not text.isdigit():
        raise argparse.ArgumentTypeError("must not be negative")
    return int(text)


def _unit(text: str) -> float:
    try:
        value = float(text)
    except ValueError:
        value = -1.0
    if not 0 <= value <= 1:
        raise argparse.ArgumentTypeError("must be from 0 to 1")
    return value


class _Parser(argparse.ArgumentParser):
    def error(self, message: str):
        self.print_usage(sys.stderr)
        self.exit(FAILED, f"{self.prog}: {message}\n")


def parser() -> argparse.ArgumentParser:
    out = _Parser(prog="quillstone", description=__doc__)
    commands = out.add_subparsers(dest="command", required=True, parser_class=_Parser)
    s = commands.add_parser("search", help="search the index")
    s.add_argument("query")
    for flag, kind in (("--folder", str), ("--filter", str), ("--linear-alpha", _unit), ("--mmr", _unit), ("--rrf-k", _positive), ("--max-chunks-per-doc", _positive), ("--top-k", _positive), ("--fetch-k", _positive)):
        s.add_argument(flag, type=kind)
    s.add_argument("--tag", action="append", default=[])
    s.add_argument("--context", type=_natural, default=0)
    s.add_argument("--mode", choices=("dense", "fts", "hybrid"))
    s.add_argument("--metric", choices=("cosine", "dot", "l2"))
    s.add_argument("--fusion", choices=("rrf", "linear"))
    s.add_argument("--provider", choices=("npu", "cpu", "auto"))
    for flag in ("--group-by-folder", "--json", "--no-color", "--rollup"):
        s.add_argument(flag, action="store_true")
    i = commands.add_parser("index", help="bring the index up to the archive")
    i.add_argument("--archive-path")
    i.add_argument("--provider", choices=("npu", "cpu", "auto"))
    for flag in ("--full-rebuild", "--json"):
        i.add_argument(flag, action="store_true")
    for name, text in (("status", "show what the index holds"), ("tags", "list the tags and their folders")):
        commands.add_parser(name, help=text).add_argument("--json", action="store_true")
    return out


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("quillstone").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def _tables(config):
    from .plans.embed import HashingEmbedder
    from .plans.ingest import State
    from .schema import CHUNKS as shape
    from .sources.store import Snapshots

    if config.model != "hashing":
        raise ConfigurationError(f"no runtime for the model {config.model} is installed")
    spark = _session()
    return spark, Snapshots(spark, f"{config.index_path}/chunks", shape), State(spark, f"{config.index_path}/state"), HashingEmbedder()


def _search(args, config) -> str:
    from .plans import compat, render
    from .plans.config import MODES
    from .plans.embed import embed_queries
    from .plans.search import Options, search

    tags = config.registry()
    names = [t.strip() for group in args.tag for t in group.split(",") if t.strip()]
    scope = tags.sql(args.folder, names, args.filter)
    options = Options(mode=MODES[config.mode], metric=config.metric, fusion=config.fusion, limit=config.top_k, fetch_k=args.fetch_k, rrf_k=config.rrf_k, linear_alpha=0.5 if args.linear_alpha is None else args.linear_alpha, mmr_diversity=args.mmr, max_chunks_per_document=args.max_chunks_per_doc, rollup=args.rollup, context_window=args.context, filter_sql=scope)
    spark, index, _, embedder = _tables(config)
    if index.version() is None:
        raise ConfigurationError(f"there is no index at {config.index_path}: run `quillstone index` first")
    chunks = index.read()
    if options.mode != "lexical_only":
        compat.verify(chunks, embedder.identity)
    began = time.time()
    asked = embed_queries(spark.createDataFrame([(0, args.query)], "query_id int, query string"), embedder)
    rows = render.placed(search(chunks, asked, options), config.archive_path or None, tags, args.group_by_folder).persist()
    total = (rows.agg({"total_candidates": "max"}).first()[0]) or 0
    if args.json:
        return render.search_json(rows, args.query, options.mode, "cpu", args.group_by_folder, total, time.time() - began)
    color = render.may_color(args.no_color, sys.stdout.isatty(), os.environ)
    return render.search_text(rows, args.query, options.mode, "cpu", args.group_by_folder, color)


def _index(args, config) -> str:
    from .plans import ingest, render, sync

    if not config.archive_path:
        raise ConfigurationError("no archive is set: give --archive-path")
    spark, index, state, embedder = _tables(config)
    if args.full_rebuild:
        index.drop()
        state.drop()
    report = ingest.run(spark, [config.archive_path], state, IngestParams())
    done = sync.sync(report.records, report.removed, index, embedder)
    return render.summary(done, report.files, [(r[0], r[1]) for r in report.omission_counts().collect()], args.json)


def _status(args, config) -> str:
    from .sources.store import stats

    _, index, _, _ = _tables(config)
    if index.version() is None:
        raise ConfigurationError(f"there is no index at {config.index_path}")
    found = stats(index.read()).first().asDict() | {"bytes": index.bytes(), "dimension": len(index.read().select("vector").first()[0]) if index.read().limit(1).count() else None}
    found["mixed_model"] = len(found["identities"]) + bool(found["unstamped"]) > 1
    return json.dumps(found, indent=2) if args.json else "\n".join(f"{k}: {v}" for k, v in found.items())


def _tags(args, config) -> str:
    tags = {k: list(v) for k, v in sorted(config.tags.items())}
    return json.dumps(tags, ensure_ascii=False, indent=2) if args.json else "\n".join(f"{k}: {', '.join(v)}" for k, v in tags.items()) or "no tags are set"


def main(argv: Sequence[str] | None = None) -> int:
    args = parser().parse_args(argv)
    from .plans import config as settings

    try:
        given = {k: v for k, v in vars(args).items() if k in ("archive_path", "provider", "mode", "metric", "fusion", "top_k", "rrf_k")}
        print({"search": _search, "index": _index, "status": _status, "tags": _tags}[args.command](args, settings.load(given)))
    except EngineError as e:
        print(f"quillstone: {e}", file=sys.stderr)
        return FAILED
    return OK


__all__ = ["CHUNKS", "main", "parser"]

if __name__ == "__main__":
    sys.exit(main())
