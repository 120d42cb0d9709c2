"""Chunking: segments of a file, in order, into chunks under a token budget.

The fold over a file's segments is sequential, so a file is one group; files are independent. Token
counts come from a pluggable counter of the rendered document template, title included.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cache
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import ConfigurationError, IngestParams, canonical_json, chunk_id, sha256_hex

DOCUMENT = "title: {title} | text: {content}"


class Tokens(Protocol):
    """encode gives tokens whose concatenation by decode is the text, up to white space.

    `extra` tokens are put around every text (marks of its start and end). If `additive`, a text
    between blank lines has as many tokens as its parts, so each part is counted once.
    """

    additive: bool
    extra: int

    def encode(self, text: str) -> list: ...

    def decode(self, tokens: list) -> str: ...


class WordTokens:
    """Words and marks with the white space before them: deterministic, and exact when decoded."""

    PIECE = re.compile(r"\s*(?:\w+|[^\w\s])")
    additive, extra = True, 0

    def encode(self, text: str) -> list[str]:
        return self.PIECE.findall(text)

    def decode(self, tokens: list[str]) -> str:
        return "".join(tokens).strip()


@dataclass(frozen=True)
class RankTokens:
    """Byte-level BPE by a local rank file and its pattern; `extra` special tokens surround a text."""

    path: str
    pattern: str
    extra: int = 2
    additive = False

    def _coder(self):
        return _coder(self.path, self.pattern)

    def encode(self, text: str) -> list[int]:
        return self._coder().encode_ordinary(text)

    def decode(self, tokens: list[int]) -> str:
        return self._coder().decode_bytes(tokens).decode("utf-8", "ignore").strip()

    def padded(self, texts: list[str], length: int, start: int = 0, end: int = 0, pad: int = 0) -> tuple[list[list[int]], list[list[int]], list[int]]:
        """(ids, mask, places of the texts that were cut): start, at most length - extra tokens, end, then padding."""
        ids, masks, cut = [], [], []
        for place, text in enumerate(texts):
            found = self.encode(text)
            if len(found) > length - self.extra:
                cut.append(place)
            marks = ([start], [end]) if self.extra == 2 else ([], [])
            row = [*marks[0], *found[: length - self.extra], *marks[1]]
            ids.append(row + [pad] * (length - len(row)))
            masks.append([1] * len(row) + [0] * (length - len(row)))
        return ids, masks, cut


@cache
def _coder(path: str, pattern: str):
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@dataclass
class Draft:
    kind: str
    text: str
    locator_type: str
    locator: dict
    headings: tuple[str, ...] = ()
    truncated: bool = False
    provenance: str | None = None


@dataclass
class Folder:
    """The fold over one file's segments."""

    title: str | None
    budget: int
    overlap: int
    tokens: Tokens
    template: str = DOCUMENT
    drafts: list[Draft] = field(default_factory=list)
    body: list[str] = field(default_factory=list)
    places: list[tuple[str, dict]] = field(default_factory=list)
    headings: tuple[str, ...] | None = None
    carried: str = ""

    def __post_init__(self) -> None:
        self.shell = len(self.tokens.encode(self._rendered(""))) + self.tokens.extra
        self.used = 0

    def _rendered(self, text: str) -> str:
        return self.template.replace("{title}", self.title or "none").replace("{content}", text)

    def size(self, text: str) -> int:
        """Tokens of the rendered template with this text, special ones too."""
        if self.tokens.additive:
            return self.shell + len(self.tokens.encode(text))
        return len(self.tokens.encode(self._rendered(text))) + self.tokens.extra

    def fits(self, text: str) -> bool:
        return self.size(text) <= self.budget

    def longest(self, n: int, text: Callable[[int], str], rest: int = 0) -> str:
        """text(k) for the largest k <= n that fits; k = 0 is the fallback. text(k) has k + rest tokens."""
        if self.tokens.additive:
            return text(max(0, min(n, self.budget - self.shell - rest)))
        low, high = 0, n
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if self.fits(text(middle)) else (low, middle - 1)
        return text(low)

    def shortened(self, text: str) -> tuple[str, bool]:
        """The text, or its longest run of first tokens within the budget."""
        tokens = self.tokens.encode(text)
        if self.shell + len(tokens) <= self.budget if self.tokens.additive else self.fits(text):
            return text, False
        return self.longest(len(tokens), lambda k: self.tokens.decode(tokens[:k])), True

    def flush(self, carry: bool) -> None:
        """Ends a prose chunk: what was carried over is cut from its front until all fits."""
        if self.body:
            body, cut = self.shortened("\n\n".join(self.body))
            whole = body
            if self.carried and not cut:
                tail = self.tokens.encode(self.carried)
                rest = len(self.tokens.encode(body)) if self.tokens.additive else 0
                whole = self.longest(len(tail), lambda k: f"{self.tokens.decode(tail[len(tail) - k:])}\n\n{body}" if k else body, rest)
            (kind, first), (_, last) = self.places[0], self.places[-1]
            place = dict(first)
            if kind == "markdown" and "line_range" in last:
                place["line_range"] = [first["line_range"][0], last["line_range"][1]]
            self.drafts.append(Draft("prose", whole, kind, place, self.headings or (), cut))
            tokens = self.tokens.encode(whole)
            self.carried = self.tokens.decode(tokens[-self.overlap :]) if carry and self.overlap else ""
        if not carry:
            self.carried = ""
        self.body, self.places = [], []
        self.used = self.shell + (len(self.tokens.encode(self.carried)) if self.carried else 0)

    def add(self, s: dict) -> None:
        place = (s["locator_type"], json.loads(s["locator_json"]))
        if s["kind"] != "prose":
            self.flush(False)
            self.headings = None
            texts = self.split_block(s) if s["kind"] == "block" else [self.shortened(s["text"])]
            self.drafts += [Draft(s["kind"], t, *place, tuple(s["heading_path"] if s["heading_path"] is not None else ()), cut, s["provenance_json"]) for t, cut in texts]
            return
        path = tuple(s["heading_path"] if s["heading_path"] is not None else ())
        if self.headings is not None and path != self.headings:
            self.flush(False)
        self.headings = path
        more = len(self.tokens.encode(s["text"])) if self.tokens.additive else 0
        if self.body and not (self.used + more <= self.budget if self.tokens.additive else self.fits("\n\n".join([*([self.carried] if self.carried else []), *self.body, s["text"]]))):
            self.flush(True)
        if not self.body:
            self.used = self.shell + (len(self.tokens.encode(self.carried)) if self.carried else 0)
        self.used += more
        self.body.append(s["text"])
        self.places.append(place)

    def split_block(self, s: dict) -> list[tuple[str, bool]]:
        """Pieces of a block's rows under its label and header, as many rows as fit; a row too long is cut."""
        head = [*([s["label"]] if s["label"] else []), *([" | ".join(s["header_row"])] if s["header_row"] is not None and len(s["header_row"]) else [])]
        rows = [" | ".join(r) for r in (s["rows"] if s["rows"] is not None else [])]
        text = lambda lines: "\n".join([*head, *lines])
        if self.fits(text(rows)):
            return [(text(rows), False)]
        out: list[tuple[str, bool]] = []
        now: list[str] = []
        for row in rows:
            if self.fits(text([*now, row])):
                now.append(row)
                continue
            if now:
                out.append((text(now), False))
            one, cut = self.shortened(text([row]))
            now = [] if cut else [row]
            if cut:
                out.append((one, True))
        return [*out, (text(now), False)] if now else out


_KINDS = {"chunk_index": T.LongType(), "token_count": T.LongType(), "truncated": T.BooleanType(), "headings": T.ArrayType(T.StringType())}
CHUNK_ROWS = T.StructType([T.StructField(n, _KINDS.get(n, T.StringType())) for n in ("chunk_id", "root_id", "relative_path", "author", "file_path", "file_hash", "chunk_index", "chunk_kind", "title", "headings", "locator_type", "locator_json", "text", "token_count", "truncated", "provenance_json")])


def fold_file(rows: list[dict], params: IngestParams, tokens: Tokens) -> Iterator[tuple]:
    first, print_ = rows[0], params.fingerprint()
    f = Folder(first["title"], params.token_budget, params.prose_overlap_tokens, tokens)
    for row in sorted(rows, key=lambda r: r["seg_no"]):
        f.add(row)
    f.flush(False)
    for n, d in enumerate(f.drafts):
        place = {"type": d.locator_type, **d.locator}
        yield (chunk_id(first["root_id"], first["relative_path"], d.kind, place, n, print_), first["root_id"], first["relative_path"], first["author"], f"{first['root_id']}/{first['relative_path']}", first["file_hash"], n, d.kind, first["title"], list(d.headings), d.locator_type, canonical_json(d.locator), d.text, f.size(d.text), d.truncated, d.provenance)


def chunk_segments(segments: DataFrame, params: IngestParams, tokens: Tokens | None = None) -> DataFrame:
    """Chunks (`CHUNK_ROWS`) of segment rows with root_id, relative_path, author, title and file_hash."""
    if params.token_budget <= 0 or not 0 <= params.prose_overlap_tokens < params.token_budget:
        raise ConfigurationError("the budget must be positive and larger than the overlap")
    counter = tokens or WordTokens()
    keys = ["root_id", "relative_path"]
    shape = pa.schema([(f.name, {T.LongType(): pa.int64(), T.BooleanType(): pa.bool_(), T.StringType(): pa.string()}.get(f.dataType, pa.list_(pa.string()))) for f in CHUNK_ROWS])

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(shape)], schema=shape)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Files come one after another, so only one file's segments are held."""
        held: list[dict] = []
        out: list[tuple] = []
        for part in parts:
            for row in part.to_pylist():
                if held and any(row[k] != held[0][k] for k in keys):
                    out += fold_file(held, params, counter)
                    held = []
                held.append(row)
                if len(out) >= 1000:
                    yield batch(out)
                    out = []
        if held:
            out += fold_file(held, params, counter)
        if out:
            yield batch(out)

    return segments.repartition(*keys).sortWithinPartitions(*keys, "seg_no").mapInArrow(run, CHUNK_ROWS)


def text_segments(texts: DataFrame, by_paragraph: bool = False) -> DataFrame:
    """Prose segments of plain texts: the whole text, or each paragraph (which loses nothing of a long one)."""
    lines = F.split("text", "\n")
    whole = F.struct(F.lit(0).alias("seg_no"), F.trim(F.regexp_replace("text", r"[ \t\n\r]+", " ")).alias("t"), F.lit(1).alias("a"), F.size(lines).alias("b"))
    rows = texts
    if by_paragraph:
        cut = F.transform(lines, lambda x, i: F.struct(i.alias("seg_no"), F.trim(F.regexp_replace(x, r"[ \t\r]+", " ")).alias("t"), (i + 1).alias("a"), (i + 1).alias("b")))
        rows = rows.withColumn("_s", F.explode(cut))
    else:
        rows = rows.withColumn("_s", whole)
    null = lambda kind: F.lit(None).cast(kind)
    have = lambda c, other: F.col(c) if c in texts.columns else other
    return rows.where("_s.t <> ''").select("root_id", "relative_path", "author", have("title", null("string")).alias("title"), have("file_hash", F.sha2("text", 256)).alias("file_hash"), "_s.seg_no", F.lit("prose").alias("kind"), F.col("_s.t").alias("text"), F.array().cast("array<string>").alias("heading_path"), null("string").alias("label"), null("array<string>").alias("header_row"), null("array<array<string>>").alias("rows"), F.lit("markdown").alias("locator_type"), F.format_string('{"line_range":[%d,%d],"ordinal":%d}', "_s.a", "_s.b", "_s.seg_no").alias("locator_json"), null("string").alias("image_ref"), null("string").alias("provenance_json"))


def _quoted(text: Column) -> Column:
    """A JSON string, with the escapes of the canonical form for quotes, backslashes and line ends."""
    out = text
    for what, by in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(what), F.lit(by))
    return F.concat(F.lit('"'), out, F.lit('"'))


def chunk_id_column(root_id: Column, relative_path: Column, kind: Column, locator_json: Column, ordinal: Column, params: Column) -> Column:
    """`chunk_id` on the JVM, for parts without control characters beyond line ends and tabs."""
    pairs = (("kind", _quoted(kind)), ("locator", locator_json), ("ordinal", ordinal.cast("string")), ("params", _quoted(params)), ("relative_path", _quoted(relative_path)), ("root_id", _quoted(root_id)))
    parts = [x for i, (k, v) in enumerate(pairs) for x in (F.lit(f'{"," if i else "{"}"{k}":'), v)]
    return F.sha2(F.concat(*parts, F.lit("}")), 256)


__all__ = ["CHUNK_ROWS", "Draft", "Folder", "RankTokens", "Tokens", "WordTokens", "chunk_id_column", "chunk_segments", "fold_file", "sha256_hex", "text_segments"]
