"""The tables of the engine, their enumerations, identities and errors."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class EngineError(Exception):
    """Any failure that the engine reports by itself."""


class StoreError(EngineError):
    pass


class QueryError(EngineError):
    pass


class SchemaError(EngineError):
    pass


class ConfigurationError(EngineError):
    pass


#: What a chunk, a file, an omission and a search can be.
CHUNK_KINDS = ("prose", "table", "block", "formula", "figure")
LOCATOR_TYPES = ("markdown", "page", "sheet", "image_file")
OMISSIONS = ("root_unavailable", "unsupported", "unreadable", "failed", "below_threshold", "value_unavailable", "hidden_sheet", "vision_unavailable", "vision_failed")
FILE_STATUS = ("new", "changed", "unchanged")
MODES = ("dense_only", "lexical_only", "hybrid")
METRICS = ("cosine", "dot", "l2")
FUSIONS = ("rrf", "linear")

CHUNKS = T.StructType([
    T.StructField("chunk_id", T.StringType(), False),
    T.StructField("file_path", T.StringType(), False),
    T.StructField("file_hash", T.StringType(), False),
    T.StructField("chunk_index", T.LongType(), False),
    T.StructField("chunk_kind", T.StringType(), False),
    T.StructField("title", T.StringType()),
    T.StructField("headings", T.ArrayType(T.StringType()), False),
    T.StructField("locator_type", T.StringType(), False),
    T.StructField("locator_json", T.StringType(), False),
    T.StructField("text", T.StringType(), False),
    T.StructField("vector", T.ArrayType(T.FloatType()), False),
    T.StructField("token_count", T.LongType(), False),
    T.StructField("created_at", T.DoubleType(), False),
    T.StructField("root_id", T.StringType()),
    T.StructField("author", T.StringType()),
    T.StructField("truncated", T.BooleanType()),
    T.StructField("provenance_json", T.StringType()),
    T.StructField("model_identity", T.StringType()),
])

#: A chunk before it has a vector: what ingestion hands to the index.
RECORDS = T.StructType([f for f in CHUNKS if f.name not in ("vector", "created_at", "model_identity")] + [T.StructField("relative_path", T.StringType(), False)])

#: What extraction makes of a file, in order of seg_no; columns that a kind lacks are null.
SEGMENTS = T.StructType([
    T.StructField("seg_no", T.IntegerType(), False),
    T.StructField("kind", T.StringType(), False),
    T.StructField("text", T.StringType()),
    T.StructField("heading_path", T.ArrayType(T.StringType())),
    T.StructField("label", T.StringType()),
    T.StructField("header_row", T.ArrayType(T.StringType())),
    T.StructField("rows", T.ArrayType(T.ArrayType(T.StringType()))),
    T.StructField("locator_type", T.StringType(), False),
    T.StructField("locator_json", T.StringType(), False),
    T.StructField("image_ref", T.StringType()),
    T.StructField("provenance_json", T.StringType()),
])

FILE_STATE = T.StructType([T.StructField(n, T.StringType(), False) for n in ("root_id", "relative_path", "content_hash", "params_fingerprint", "status", "last_seen_run")])
REGISTRY = T.StructType([T.StructField(n, T.StringType(), False) for n in ("chunk_id", "root_id", "relative_path", "record_json")])
VISION_CACHE = T.StructType([T.StructField(n, T.StringType(), False) for n in ("image_sha256", "model_id", "prompt_version", "text", "created_at")])
OMISSION_ROWS = T.StructType([T.StructField("category", T.StringType(), False), T.StructField("path", T.StringType(), False), T.StructField("reason", T.StringType()), T.StructField("missing_capability", T.StringType())])


def canonical_json(value: object) -> str:
    """JSON with sorted keys, no blanks and no escapes of non-ASCII characters; identities hash it."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def sha256_hex(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


@dataclass(frozen=True)
class IngestParams:
    """Everything that changes what ingestion makes of a file's bytes."""

    extractor_versions: Mapping[str, str] = field(default_factory=dict)
    min_image_pixels: int = 200
    min_page_chars: int = 50
    prompt_version: str = ""
    prose_overlap_tokens: int = 64
    token_budget: int = 512
    tokenizer_id: str = "regex-words"
    vision_model: str = ""

    def fingerprint(self) -> str:
        return sha256_hex(canonical_json({k: dict(v) if isinstance(v, Mapping) else v for k, v in vars(self).items()}))


def chunk_id(root_id: str, relative_path: str, kind: str, locator: object, ordinal: int, params: str) -> str:
    """The identity of a chunk's place: its text is no part of it, so an edit in place keeps the id."""
    return sha256_hex(canonical_json({"kind": kind, "locator": locator, "ordinal": ordinal, "params": params, "relative_path": relative_path, "root_id": root_id}))


def content_hash(content: str | Column) -> Column:
    return F.sha2(F.col(content) if isinstance(content, str) else content, 256)


def model_identity(model_id: str, dimension: int) -> str:
    """`<model>:<dimension>`; what it refuses could not be told apart later."""
    if not model_id.strip() or model_id != model_id.strip() or any(c.isspace() for c in model_id):
        raise SchemaError("a model id must be a name without blanks")
    if isinstance(dimension, bool) or dimension <= 0:
        raise SchemaError("a dimension must be a positive number")
    return f"{model_id}:{dimension}"


def storable_identity(identity: str) -> str:
    """The identity, if it may be stored: empty (unstamped), or a name and a number."""
    name, _, digits = identity.rpartition(":")
    if identity and not (name.strip() and digits.isdigit() and not any(c.isspace() for c in identity)):
        raise SchemaError(f"not a model identity: {identity!r}")
    return identity
