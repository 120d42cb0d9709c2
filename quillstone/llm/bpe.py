"""Byte-level BPE with the tiktoken library and a local rank file.

Each match of the pattern is merged separately, so a text may be cut wherever a match surely
begins: before white space that follows another character. Long texts are encoded in such
parts, which keeps the library's memory bounded, and the ids are those of the whole text.

Defined results: a null or empty text has no ids and decodes to no bytes; repeated rows give
equal rows; further columns of the input are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from ._grams import trim

#: Code points of a text that are encoded at once; a part ends at the next safe boundary.
PART = 1 << 16
#: A place where every match ends: a character that is no white space before one that is.
BOUNDARY = re.compile(r"(?<=[^\s])(?=[ \n])")


def ranks_of(rank_file: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in rank_file.splitlines() if line)}


@cache
def encoding(rank_file: bytes, pattern: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks_of(rank_file), special_tokens={})


def parts(text: str, size: int = PART) -> Iterator[str]:
    """The text in parts of about `size` code points, cut at safe boundaries only."""
    start = 0
    while len(text) - start > size:
        found = BOUNDARY.search(text, start + size)
        if not found:
            break
        yield text[start : found.start()]
        start = found.start()
    yield text[start:]


def encode(coder: tiktoken.Encoding, text: str, size: int = PART) -> np.ndarray:
    """The ids of a whole text as little-endian unsigned 32-bit integers."""
    if len(text) <= size:
        return np.array(coder.encode_ordinary(text), "<u4")
    return np.concatenate([np.array(coder.encode_ordinary(part), "<u4") for part in parts(text, size)])


def decode(coder: tiktoken.Encoding, ids: np.ndarray, size: int = PART) -> bytes:
    """The raw bytes of the ids; they need not be valid UTF-8."""
    return b"".join(coder.decode_bytes(ids[i : i + size].tolist()) for i in range(0, len(ids), size))


def encode_texts(documents: DataFrame, rank_path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, ids (little-endian 32-bit, as binary): the ids of each whole text."""
    held = documents.sparkSession.sparkContext.broadcast(open(rank_path, "rb").read())  # a vocabulary has a fixed size

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoding(held.value, pattern)
        for frame in frames:
            for i in range(0, len(frame), 512):
                part = frame.slice(i, 512)
                ids = [encode(coder, x.as_py() or "") for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())], [key, "n_tokens", "ids"])

    return documents.select(key, text).mapInArrow(run, f"{key} {documents.schema[key].dataType.simpleString()}, n_tokens long, ids binary")


def decode_ids(encoded: DataFrame, rank_path: str, pattern: str, key: str = "doc_id") -> DataFrame:
    """key, n_tokens, ids_sha256, decoded_sha256 for the rows of `encode_texts`."""
    held = encoded.sparkSession.sparkContext.broadcast(open(rank_path, "rb").read())

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoding(held.value, pattern)
        for frame in frames:
            ids = [x.as_py() for x in frame.column(2)]
            decoded = [hashlib.sha256(decode(coder, np.frombuffer(x, "<u4"))).hexdigest() for x in ids]
            yield pa.RecordBatch.from_arrays([frame.column(0), frame.column(1), pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()), pa.array(decoded, pa.string())], [key, "n_tokens", "ids_sha256", "decoded_sha256"])

    return encoded.mapInArrow(run, f"{key} {encoded.schema[key].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def digests(documents: DataFrame, rank_path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """What `decode_ids` gives for `encode_texts`, text by text in one pass: the ids never leave the worker."""
    held = documents.sparkSession.sparkContext.broadcast(open(rank_path, "rb").read())

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoding(held.value, pattern)
        for frame in frames:
            rows = []
            for x in frame.column(1):
                ids = encode(coder, x.as_py() or "")
                rows.append((len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(decode(coder, ids)).hexdigest()))
            yield pa.RecordBatch.from_arrays([frame.column(0), *(pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.string(), pa.string())))], [key, "n_tokens", "ids_sha256", "decoded_sha256"])
        trim()

    return documents.select(key, text).mapInArrow(run, f"{key} {documents.schema[key].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
