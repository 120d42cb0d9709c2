"""Extraction: the bytes of a file into ordered segments, or the reason why there are none.

Each extractor is a plain function of bytes, run file by file in Arrow batches; a file that fails
gives one omission and doesn't touch the others.
"""

from __future__ import annotations

import io
import json
import posixpath
import re
import struct
import unicodedata
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import SEGMENTS

Segment = dict
Omission = tuple[str, str]


def clean(text: str) -> str:
    return re.sub(r"[ \t\n\r]+", " ", unicodedata.normalize("NFC", text)).strip()


def segment(n: int, kind: str, locator_type: str, locator: dict, **rest) -> Segment:
    return {f.name: None for f in SEGMENTS} | {"seg_no": n, "kind": kind, "locator_type": locator_type, "locator_json": json.dumps(locator, separators=(",", ":"))} | rest


def text(content: bytes) -> tuple[str | None, list[Segment], list[Omission]]:
    """The whole file as one prose segment."""
    found = content.decode("utf-8")
    body = clean(found)
    lines = len(found.splitlines())
    return None, [segment(0, "prose", "markdown", {"line_range": [1, max(1, lines)], "ordinal": 0}, text=body, heading_path=[])] if body else [], []


# Markdown: a bounded parser of blocks

FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})(.*)$")
ATX = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
RULE = re.compile(r"^ {0,3}([-*_])(?:[ \t]*\1){2,}[ \t]*$")
ITEM = re.compile(r"^\s*(?:[-*+]|\d{1,9}[.)])(?:[ \t]+|$)")
HTML = re.compile(r"^ {0,3}<(?:[A-Za-z/!?])")
DEFINITION = re.compile(r"^ {0,3}\[[^\]]+\]:[ \t]*\S+")
DELIMITER = re.compile(r"^[ \t]*\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
IMAGE = re.compile(r"!\[([^\]]*)\]\(\s*<?([^)\s>]+)>?(?:\s+[\"'(][^)]*[\"')])?\s*\)")
INLINE = ((re.compile(r"\[([^\]\[]*)\]\([^)]*\)"), r"\1"), (re.compile(r"\[([^\]\[]+)\]\[[^\]]*\]"), r"\1"), (re.compile(r"<((?:https?|mailto):[^>\s]+)>"), r"\1"), (re.compile(r"</?[A-Za-z][^>]*>"), ""), (re.compile(r"(`+)(.+?)\1"), r"\2"), (re.compile(r"(\*\*\*|\*\*|\*|~~)(?=\S)(.+?)(?<=\S)\1"), r"\2"), (re.compile(r"(?<![A-Za-z0-9_])(__|_)(?=\S)(.+?)(?<=\S)\1(?![A-Za-z0-9_])"), r"\2"), (re.compile(r"\\([!-/:-@\[-`{-~])"), r"\1"))


def visible(source: str) -> str:
    """What a reader sees of inline Markdown."""
    for pattern, by in INLINE:
        before = None
        while before != source:
            before, source = source, pattern.sub(by, source)
    return clean(source)


def front_matter(lines: list[str]) -> tuple[str | None, int]:
    """(title, lines to skip) of a leading block between rules of dashes, the end at least as long as the start."""
    start = re.match(r"^(-{3,})\s*$", lines[0]) if lines else None
    if not start:
        return None, 0
    title = None
    for n, line in enumerate(lines[1:], 1):
        end = re.match(r"^(-{3,})\s*$", line)
        if end and len(end.group(1)) >= len(start.group(1)):
            return title, n + 1
        if title is None and (found := re.match(r"^title:\s*(.*)$", line)):
            value = found.group(1).strip()
            if len(value) >= 2 and value[0] == value[-1] and value[0] in "'\"":
                value = value[1:-1]
            title = clean(value) or None
    return None, 0


def cells(line: str) -> list[str]:
    inner = line.strip().removeprefix("|")
    inner = inner[:-1] if inner.endswith("|") and not inner.endswith("\\|") else inner
    return [visible(c.replace("\\|", "|")) for c in re.split(r"(?<!\\)\|", inner)]


def markdown(content: bytes) -> tuple[str | None, list[Segment], list[Omission]]:
    """Prose, tables and images in order; heading texts are kept as paths, not as segments."""
    lines = content.decode("utf-8").splitlines()
    title, at = front_matter(lines)
    out: list[Segment] = []
    path: list[tuple[int, str]] = []
    first_heading = None

    def emit(kind: str, a: int, b: int, **rest) -> None:
        out.append(segment(len(out), kind, "markdown", {"line_range": [a + 1, b], "ordinal": len(out)}, heading_path=[h for _, h in path], **rest))

    def prose(a: int, b: int, block: str) -> None:
        last = 0
        for image in IMAGE.finditer(block):
            if body := visible(block[last : image.start()]):
                emit("prose", a, b, text=body)
            emit("image", a, b, image_ref=image.group(2), text=image.group(1))
            last = image.end()
        if body := visible(block[last:]):
            emit("prose", a, b, text=body)

    while at < len(lines):
        line, start = lines[at], at
        if not line.strip() or RULE.match(line) or DEFINITION.match(line):
            at += 1
        elif fence := FENCE.match(line):
            at += 1
            while at < len(lines) and not re.match(rf"^ {{0,3}}{re.escape(fence.group(1)[0])}{{{len(fence.group(1))},}}\s*$", lines[at]):
                at += 1
            if body := clean("\n".join(lines[start + 1 : at])):
                emit("prose", start, min(len(lines), at + 1), text=body)
            at += 1
        elif heading := ATX.match(line):
            level, name = len(heading.group(1)), visible(heading.group(2) or "")
            path = [(k, h) for k, h in path if k < level] + [(level, name)]
            first_heading = first_heading or name or None
            at += 1
        elif HTML.match(line):
            while at < len(lines) and lines[at].strip():
                at += 1
        elif "|" in line and at + 1 < len(lines) and DELIMITER.match(lines[at + 1]) and "|" in lines[at + 1]:
            rows = [cells(line)]
            at += 2
            while at < len(lines) and "|" in lines[at] and lines[at].strip():
                rows.append(cells(lines[at]))
                at += 1
            if body := " ".join(c for r in rows for c in r if c):
                emit("table", start, at, text=body)
        else:
            block = [ITEM.sub("", re.sub(r"^ {0,3}(?:> ?)+", "", line))]
            at += 1
            while at < len(lines) and lines[at].strip() and not (ATX.match(lines[at]) or FENCE.match(lines[at]) or ITEM.match(lines[at])):
                under = re.match(r"^ {0,3}(=+|-+)\s*$", lines[at])
                if under:
                    level, name = (1 if under.group(1)[0] == "=" else 2), visible(" ".join(block))
                    path = [(k, h) for k, h in path if k < level] + [(level, name)]
                    first_heading, block = first_heading or name or None, []
                    at += 1
                    break
                if RULE.match(lines[at]):
                    break
                block.append(re.sub(r"^ {0,3}(?:> ?)+", "", lines[at]))
                at += 1
            if block:
                prose(start, at, "\n".join(block))
    return title or first_heading, out, []


# Workbooks: sheets of cells from the file's XML

_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def column_number(letters: str) -> int:
    n = 0
    for c in letters:
        n = n * 26 + ord(c) - 64
    return n


def column_letters(n: int) -> str:
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def _sheets(book: zipfile.ZipFile) -> Iterator[tuple[str, str, bool, dict[tuple[int, int], tuple[str | None, str | None]], list[tuple[int, int, int, int]]]]:
    """(name, member, hidden, cells as (row, column) -> (value, formula), merged ranges) of each sheet."""
    root = ElementTree.fromstring(book.read("xl/workbook.xml"))
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    strings = []
    if "xl/sharedStrings.xml" in book.namelist():
        strings = ["".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")) for si in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).findall("m:si", _NS)]
    for sheet in root.find("m:sheets", _NS):
        target = targets[sheet.get(_REL)].lstrip("/")
        part = target if target.startswith("xl/") else f"xl/{target}"
        tree = ElementTree.fromstring(book.read(part))
        found = {}
        for c in tree.iter(f"{{{_NS['m']}}}c"):
            letters, number = re.match(r"([A-Z]+)(\d+)", c.get("r")).groups()
            value, formula, kind = c.find("m:v", _NS), c.find("m:f", _NS), c.get("t", "n")
            raw = value.text if value is not None else None
            if kind == "s" and raw is not None:
                raw = strings[int(raw)]
            elif kind == "inlineStr":
                raw = "".join(t.text or "" for t in c.iter(f"{{{_NS['m']}}}t"))
            elif kind == "b" and raw is not None:
                raw = "True" if raw == "1" else "False"
            elif kind == "n" and raw is not None and float(raw) == int(float(raw)):
                raw = str(int(float(raw)))
            found[int(number), column_number(letters)] = (clean(raw) if raw else None, formula.text if formula is not None else None)
        merged = []
        for m in tree.iter(f"{{{_NS['m']}}}mergeCell"):
            a, b, c, d = re.match(r"([A-Z]+)(\d+):([A-Z]+)(\d+)", m.get("ref")).groups()
            merged.append((int(b), column_number(a), int(d), column_number(c)))
        yield sheet.get("name"), part, sheet.get("state", "visible") != "visible", found, merged


_DRAWING = "{http://schemas.openxmlformats.org/drawingml/2006/spreadsheetDrawing}"
_CHART = "{http://schemas.openxmlformats.org/drawingml/2006/chart}"
_EMBED = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}embed"


def _related(book: zipfile.ZipFile, part: str) -> dict[str, str]:
    """The members that a part of the workbook refers to, by id."""
    folder, _, name = part.rpartition("/")
    listing = f"{folder}/_rels/{name}.rels"
    if listing not in book.namelist():
        return {}
    return {r.get("Id"): posixpath.normpath(posixpath.join(folder, r.get("Target"))).lstrip("/") for r in ElementTree.fromstring(book.read(listing))}


def _anchored(book: zipfile.ZipFile, sheet: str) -> Iterator[tuple[str, str, str | None]]:
    """(cell, member or `chart`, the chart's ranges) of each picture and chart that is anchored on a sheet."""
    for drawing in sorted(t for t in _related(book, sheet).values() if "/drawings/drawing" in t):
        targets = _related(book, drawing)
        for anchor in ElementTree.fromstring(book.read(drawing)):
            corner = anchor.find(f"{_DRAWING}from")
            if corner is None:
                continue
            cell = f"{column_letters(int(corner.find(f'{_DRAWING}col').text) + 1)}{int(corner.find(f'{_DRAWING}row').text) + 1}"
            for node in anchor.iter():
                if node.get(_EMBED) in targets:
                    yield cell, targets[node.get(_EMBED)], None
                elif node.tag == f"{_CHART}chart" and node.get(_REL) in targets:
                    tree = ElementTree.fromstring(book.read(targets[node.get(_REL)]))
                    values, categories = ([f.text for part in tree.iter(f"{_CHART}{kind}") for f in part.iter(f"{_CHART}f")] for kind in ("val", "cat"))
                    parts = [f"{name}: {', '.join(found)}" for name, found in (("values", values), ("categories", list(dict.fromkeys(categories)))) if found]
                    yield cell, "chart", "; ".join(parts) or "chart"


def member(content: bytes, name: str) -> bytes:
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        return book.read(name)


def workbook(content: bytes) -> tuple[str | None, list[Segment], list[Omission]]:
    """Blocks (runs of rows with values), formulas, pictures and charts of each visible sheet."""
    out: list[Segment] = []
    omissions: list[Omission] = []
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        for name, part, hidden, grid, merged in _sheets(book):
            if hidden:
                omissions.append(("hidden_sheet", f"sheet {name} is hidden"))
                continue
            spans = {r for top, left, bottom, _ in merged if grid.get((top, left), (None,))[0] for r in range(top, bottom + 1)}
            rows = sorted({r for (r, _), (v, f) in grid.items() if v or f} | spans)
            runs: list[list[int]] = []
            for r in rows:
                if runs and r == runs[-1][-1] + 1:
                    runs[-1].append(r)
                else:
                    runs.append([r])
            for run in runs:
                used = sorted({c for (r, c), (v, _) in grid.items() if run[0] <= r <= run[-1] and v})
                if not used:
                    continue
                line = {r: [grid.get((r, c), (None, None))[0] or "" for c in used] for r in run}
                label = line[run[0]][0]
                header = next((r for r in run if any(line[r][1:])), None)
                data = [r for r in run if header is not None and r > header and any(line[r])]
                place = {"sheet": name, "cell_range": f"{column_letters(used[0])}{run[0]}:{column_letters(used[-1])}{run[-1]}"}
                out.append(segment(len(out), "block", "sheet", place, label=label, header_row=line[header] if header else [], rows=[line[r] for r in data]))
            for (r, c), (value, formula) in sorted(grid.items()):
                if formula is not None:
                    cell = f"{column_letters(c)}{r}"
                    if value is None:
                        omissions.append(("value_unavailable", f"{name}!{cell} has a formula without a stored value"))
                    else:
                        out.append(segment(len(out), "formula", "sheet", {"sheet": name, "cell_range": cell}, text=f"{name}!{cell}: ={formula} -> {value}"))
            for cell, reference, ranges in _anchored(book, part):
                out.append(segment(len(out), "image", "sheet", {"sheet": name, "cell_range": cell}, image_ref=reference, text=ranges))
    return None, out, omissions


def image_size(content: bytes) -> tuple[int, int]:
    """(width, height) from the header of a PNG, GIF, JPEG or WebP."""
    if content[:8] == b"\x89PNG\r\n\x1a\n":
        return struct.unpack(">II", content[16:24])
    if content[:4] == b"GIF8":
        return struct.unpack("<HH", content[6:10])
    if content[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(content):
            marker, size = content[at + 1], struct.unpack(">H", content[at + 2 : at + 4])[0]
            if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                height, width = struct.unpack(">HH", content[at + 5 : at + 9])
                return width, height
            at += 2 + size
    if content[:4] == b"RIFF" and content[8:12] == b"WEBP":
        return webp_size(content[12:16], content[20:])
    raise ValueError("the image's header can't be read")


def webp_size(kind: bytes, data: bytes) -> tuple[int, int]:
    """Width and height from a WebP file's first chunk: extended, lossy (a key frame) or lossless."""
    little = lambda a, b: int.from_bytes(data[a:b], "little")
    if kind == b"VP8X" and len(data) >= 10:
        return little(4, 7) + 1, little(7, 10) + 1
    if kind == b"VP8 " and data[3:6] == b"\x9d\x01\x2a" and len(data) >= 10:
        return little(6, 8) & 0x3FFF, little(8, 10) & 0x3FFF
    if kind == b"VP8L" and data[:1] == b"\x2f" and len(data) >= 5:
        bits = little(1, 5)
        return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
    raise ValueError("the image's header can't be read")


def image(content: bytes) -> tuple[str | None, list[Segment], list[Omission]]:
    width, height = image_size(content)
    return None, [segment(0, "image", "image_file", {}, image_ref=f"{width}x{height}")], []


#: Further formats are added here; a route without an extractor is an omission.
EXTRACTORS: dict[str, Callable[[bytes], tuple[str | None, list[Segment], list[Omission]]]] = {"text": text, "markdown": markdown, "excel": workbook, "image": image}

EXTRACTED = T.StructType([*(T.StructField(n, T.StringType()) for n in ("root_id", "relative_path", "author", "file_hash", "title")), *SEGMENTS, T.StructField("omission", T.StringType()), T.StructField("reason", T.StringType())])
_NAMES = [f.name for f in EXTRACTED]


def extract(files: DataFrame, extractors: dict | None = None) -> DataFrame:
    """`EXTRACTED` rows of files (root_id, relative_path, author, file_hash, route, content): segments, and omissions.

    Workbooks go by rows of cells (`workbook.extracted`) unless another reader is given for them.
    """
    from . import workbook as books

    known = EXTRACTORS | (extractors or {})
    if "excel" not in (extractors or {}):
        others = _by_file(files.where("route IS NULL OR route <> 'excel'"), known)
        return others.unionByName(books.extracted(files.where("route = 'excel'")))
    return _by_file(files, known)


def _by_file(files: DataFrame, known: dict) -> DataFrame:
    """`EXTRACTED` rows of the files, each by its route's function of bytes."""

    def rows(f) -> Iterator[dict]:
        base = {"root_id": f.root_id, "relative_path": f.relative_path, "author": f.author, "file_hash": f.file_hash}
        if f.route not in known:
            yield base | {"omission": "unsupported", "reason": f"no reader for {f.route or 'this format'} is installed"}
            return
        try:
            title, found, omitted = known[f.route](bytes(f.content))
        except Exception as e:  # one bad file must not end the run
            yield base | {"omission": "failed", "reason": f"{type(e).__name__}: {e}"[:500]}
            return
        yield from (base | {"title": title} | s for s in found)
        yield from (base | {"omission": c, "reason": r} for c, r in omitted)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for f in part.itertuples():
                yield pd.DataFrame([{n: r.get(n) for n in _NAMES} for r in rows(f)], columns=_NAMES).astype({"seg_no": "Int32"})

    shape = T.StructType([T.StructField(f.name, f.dataType, True) for f in EXTRACTED])
    return files.select("root_id", "relative_path", "author", "file_hash", "route", "content").mapInPandas(run, shape)


def segments(extracted: DataFrame) -> DataFrame:
    return extracted.where("omission IS NULL AND kind <> 'image'").drop("omission", "reason")


def images(extracted: DataFrame) -> DataFrame:
    return extracted.where("omission IS NULL AND kind = 'image'").drop("omission", "reason")


def omissions(extracted: DataFrame) -> DataFrame:
    return extracted.where("omission IS NOT NULL").select(F.col("omission").alias("category"), F.concat_ws("/", "root_id", "relative_path").alias("path"), "reason", F.lit(None).cast("string").alias("missing_capability"))
