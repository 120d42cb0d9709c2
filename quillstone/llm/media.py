"""ISO media containers: boxes, sample tables and keyframe byte ranges, without decoding payloads.

`build_movie` stores bytes losslessly as 8 x 8 pixel frames of 8-bit grey samples; `read_movie`
walks the nested boxes of any container and returns what its sample tables say. `media_columns`
is the DataFrame form over a binary column. Movie fragments and compact size tables are read too.

Defined results: null or empty content gives no track; a box that runs over its parent's end
is cut there; a table that is truncated, or counts more samples than the file can hold, gives the
error text in `error` and no ranges; ids may be of any type and null; further
columns of the input are ignored, repeated rows give equal rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._grams import batches, trim

FRAME = 64
RATE = 25
KEY_EVERY = 16
#: Boxes that hold boxes.
NESTED = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"mvex"}
MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def padded(content: bytes) -> bytes:
    """The content with bytes 0 up to a positive multiple of a frame."""
    size = max(1, -(-len(content) // FRAME)) * FRAME
    return content.ljust(size, b"\0")


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def _full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), *parts)


def build_movie(payload: bytes, frame: int = FRAME, rate: int = RATE, key_every: int = KEY_EVERY) -> bytes:
    """A container whose one video track holds the payload, frame after frame; its length is a multiple of a frame."""
    frames = len(payload) // frame
    head = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2")
    wide = len(payload) + 8 >= 1 << 32
    head += (struct.pack(">I4sQ", 1, b"mdat", len(payload) + 16) if wide else struct.pack(">I4s", len(payload) + 8, b"mdat"))
    keys = np.arange(1, frames + 1, key_every, dtype=">u4")
    chunks = len(head) + np.arange(len(keys), dtype=np.int64) * (key_every * frame)
    runs = [(1, min(frames, key_every), 1)]
    if frames > key_every and frames % key_every:
        runs.append((len(keys), frames % key_every, 1))
    entry = _box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIIIH", 8, 8, 0x480000, 0x480000, 0, 1), bytes(32), struct.pack(">Hh", 40, -1))
    far = len(chunks) and int(chunks[-1]) >= 1 << 32
    stbl = _box(
        b"stbl",
        _full(b"stsd", struct.pack(">I", 1), entry),
        _full(b"stts", struct.pack(">III", 1, frames, 1)),
        _full(b"stss", struct.pack(">I", len(keys)), keys.tobytes()),
        _full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
        _full(b"stsz", struct.pack(">II", frame, frames)),
        _full(b"co64" if far else b"stco", struct.pack(">I", len(chunks)), chunks.astype(">u8" if far else ">u4").tobytes()),
    )
    minf = _box(b"minf", _full(b"vmhd", bytes(8), flags=1), _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1))), stbl)
    mdia = _box(b"mdia", _full(b"mdhd", struct.pack(">IIIIHH", 0, 0, rate, frames, 0x55C4, 0)), _full(b"hdlr", bytes(4), b"vide", bytes(12), b"grey\0"), minf)
    tkhd = _full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, frames), bytes(8), bytes(8), MATRIX, struct.pack(">II", 8 << 16, 8 << 16), flags=7)
    mvhd = _full(b"mvhd", struct.pack(">IIIII", 0, 0, rate, frames, 0x10000), b"\x01\0", bytes(10), MATRIX, bytes(24), struct.pack(">I", 2))
    return head + payload + _box(b"moov", mvhd, _box(b"trak", tkhd, mdia))


def boxes(data: memoryview, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(kind, first byte of the body, end) of each box in a range; 64-bit and open-ended sizes too."""
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1 and body + 8 <= end:
            size, body = struct.unpack_from(">Q", data, body)[0], body + 8
        stop = end if size == 0 else min(end, start + size)
        if stop < body:
            return
        yield kind, body, stop
        start = stop


@dataclass
class Track:
    codec: str = ""
    handler: str = ""
    timescale: int = 0
    duration: int = 0
    sizes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    offsets: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    number: int = 0
    added: int = 0  # what fragments add to the duration

    @property
    def seconds(self) -> float:
        return self.duration / self.timescale if self.timescale else 0.0

    def ranges(self) -> list[tuple[int, int]]:
        """(first byte, length) of each keyframe."""
        return list(zip(self.offsets[self.keys].tolist(), self.sizes[self.keys].tolist(), strict=True))


def _entries(data: memoryview, at: int, end: int, kind: str, width: int = 1) -> np.ndarray:
    n = struct.unpack_from(">I", data, at)[0]
    step = np.dtype(kind).itemsize * width
    if at + 4 + n * step > end:
        raise ValueError("a table is longer than its box")
    return np.frombuffer(data, kind, n * width, at + 4).astype(np.int64).reshape(n, width)


def _sizes(data: memoryview, leaves: dict[bytes, tuple[int, int]]) -> np.ndarray:
    """The samples' sizes, from either form of the table; no more samples than the file has bytes."""
    if b"stz2" in leaves:
        at, end = leaves[b"stz2"]
        width, n = data[at + 7], struct.unpack_from(">I", data, at + 8)[0]
        if width not in (4, 8, 16) or at + 12 + (n * width + 7) // 8 > end:
            raise ValueError("a table is longer than its box")
        if width == 16:
            return np.frombuffer(data, ">u2", n, at + 12).astype(np.int64)
        found = np.frombuffer(data, np.uint8, (n * width + 7) // 8, at + 12).astype(np.int64)
        return found if width == 8 else np.stack([found >> 4, found & 15], 1).ravel()[:n]
    if b"stsz" not in leaves:
        return np.zeros(0, np.int64)
    at, end = leaves[b"stsz"]
    fixed, n = struct.unpack_from(">II", data, at + 4)
    if fixed * n > len(data):
        raise ValueError("the samples are longer than the file")
    return np.full(n, fixed, np.int64) if fixed else _entries(data, at + 8, end, ">u4")[:, 0]


def _track(data: memoryview, leaves: dict[bytes, tuple[int, int]]) -> Track:
    """A track from the leaf boxes below its trak box."""
    out = Track()
    if b"tkhd" in leaves:
        at, _ = leaves[b"tkhd"]
        out.number = struct.unpack_from(">I", data, at + (20 if data[at] == 1 else 12))[0]
    if b"mdhd" in leaves:
        at, _ = leaves[b"mdhd"]
        form, skip = (">IQ", 20) if data[at] == 1 else (">II", 12)
        out.timescale, out.duration = struct.unpack_from(form, data, at + skip)
    if b"stts" in leaves and not out.duration:
        times = _entries(data, leaves[b"stts"][0] + 4, leaves[b"stts"][1], ">u4", 2)
        out.duration = sum(n * delta for n, delta in times.tolist())
    if b"hdlr" in leaves:
        out.handler = bytes(data[leaves[b"hdlr"][0] + 8 :][:4]).decode("latin-1")
    if b"stsd" in leaves:
        out.codec = bytes(data[leaves[b"stsd"][0] + 12 :][:4]).decode("latin-1")
    out.sizes = _sizes(data, leaves)
    samples = len(out.sizes)
    where = leaves.get(b"co64") or leaves.get(b"stco")
    if where and b"stsc" in leaves and samples:
        chunks = _entries(data, where[0] + 4, where[1], ">u8" if b"co64" in leaves else ">u4")[:, 0]
        runs = _entries(data, leaves[b"stsc"][0] + 4, leaves[b"stsc"][1], ">u4", 3)
        begins = np.append(runs[:, 0] - 1, len(chunks))
        if not len(runs) or begins[0] or (np.diff(begins) < 0).any():
            raise ValueError("the runs of chunks aren't in order")
        per = np.repeat(runs[:, 1], np.diff(begins))
        upto = np.cumsum(per)
        owner = np.searchsorted(upto, np.arange(samples), side="right")
        if not len(per) or owner[-1] >= len(per):
            raise ValueError("the chunks hold fewer samples than there are")
        before = np.concatenate([[0], np.cumsum(out.sizes)])
        first = np.minimum(upto - per, samples)
        out.offsets = chunks[owner] + before[:-1] - before[first[owner]]
    out.keys = _entries(data, leaves[b"stss"][0] + 4, leaves[b"stss"][1], ">u4")[:, 0] - 1 if b"stss" in leaves else np.arange(samples)
    out.keys = out.keys[(out.keys >= 0) & (out.keys < len(out.offsets))]
    return out


def _optional(data: memoryview, at: int, flags: int, fields: tuple[tuple[int, str], ...]) -> tuple[dict[int, int], int]:
    """The fields whose bits are set, in order, and where they end."""
    found = {}
    for bit, form in fields:
        if flags & bit:
            found[bit] = struct.unpack_from(form, data, at)[0]
            at += struct.calcsize(form)
    return found, at


def _fragment(data: memoryview, start: int, body: int, end: int, tracks: dict[int, Track], usual: dict[int, tuple[int, int, int]]) -> None:
    """Adds the samples of a movie fragment (from its moof box) to their tracks."""
    for kind, traf, stop in boxes(data, body, end):
        if kind != b"traf":
            continue
        inner = list(boxes(data, traf, stop))
        head = next((b for k, b, _ in inner if k == b"tfhd"), None)
        if head is None:
            raise ValueError("a fragment has no header")
        flags, number = struct.unpack_from(">II", data, head)
        given, _ = _optional(data, head + 8, flags & 0xFFFFFF, ((0x1, ">Q"), (0x2, ">I"), (0x8, ">I"), (0x10, ">I"), (0x20, ">I")))
        track = tracks.setdefault(number, Track(number=number))
        duration, size, marks = (given.get(bit, old) for bit, old in zip((0x8, 0x10, 0x20), usual.get(number, (0, 0, 0)), strict=True))
        base = given.get(0x1, start)
        place = base
        for kind_, run, _ in inner:
            if kind_ != b"trun":
                continue
            flags, n = struct.unpack_from(">II", data, run)
            lead, at = _optional(data, run + 8, flags & 0xFFFFFF, ((0x1, ">i"), (0x4, ">I")))
            columns = [bit for bit in (0x100, 0x200, 0x400, 0x800) if flags & bit]
            if (n * size if 0x200 not in columns else n) > len(data) or at + 4 * n * len(columns) > len(data):
                raise ValueError("the samples are longer than the file")
            rows = np.frombuffer(data, ">u4", n * len(columns), at).astype(np.int64).reshape(n, len(columns))
            column = lambda bit, other: rows[:, columns.index(bit)] if bit in columns else np.full(n, other, np.int64)  # noqa: B023, E731
            sizes, flagged = column(0x200, size), column(0x400, marks)
            if 0x4 in lead and n:
                flagged = np.concatenate([[lead[0x4]], flagged[1:]])
            place = base + lead[0x1] if 0x1 in lead else place
            offsets = place + np.cumsum(sizes) - sizes
            place += int(sizes.sum())
            track.keys = np.concatenate([track.keys, len(track.sizes) + np.flatnonzero(flagged & 0x10000 == 0)])
            track.sizes, track.offsets = np.concatenate([track.sizes, sizes]), np.concatenate([track.offsets, offsets])
            track.added += int(column(0x100, duration).sum())


def read_movie(content: bytes) -> list[Track]:
    """The tracks of a container, fragments too, from its boxes alone; the payload is never touched."""
    data, tracks, fragments = memoryview(content), [], []
    leaves: dict[bytes, tuple[int, int]] = {}
    usual: dict[int, tuple[int, int, int]] = {}
    todo = [(0, len(data), False)]
    while todo:
        start, end, closes = todo.pop()
        if closes:
            tracks.append(_track(data, leaves))
            leaves = {}
            continue
        inner, at = [], start
        for kind, body, stop in boxes(data, start, end):
            if kind == b"trak":
                inner += [(body, stop, False), (0, 0, True)]
            elif kind in NESTED:
                inner.append((body, stop, False))
            elif kind == b"moof":
                fragments.append((at, body, stop))
            elif kind == b"trex":
                number, _, *rest = struct.unpack_from(">5I", data, body + 4)
                usual[number] = tuple(rest)
            else:
                leaves.setdefault(kind, (body, stop))
            at = stop
        todo += inner[::-1]
    if fragments:
        known = {t.number: t for t in tracks}
        for fragment in fragments:
            _fragment(data, *fragment, known, usual)
        tracks = list(known.values())
        for track in tracks:
            track.duration += track.added if not track.duration else 0
    return tracks


def stored(content: bytes, track: Track) -> bytes:
    """The bytes of a track's samples, in order; neighbouring samples are read at once."""
    if not len(track.sizes):
        return b""
    breaks = np.flatnonzero(track.offsets[1:] != track.offsets[:-1] + track.sizes[:-1]) + 1
    firsts, lasts = np.concatenate([[0], breaks]), np.concatenate([breaks, [len(track.sizes)]]) - 1
    return b"".join(content[track.offsets[i] : track.offsets[j] + track.sizes[j]] for i, j in zip(firsts, lasts, strict=True))


COLUMNS = "codec string, seconds double, n_samples long, keyframe_starts array<long>, keyframe_sizes array<long>, error string"


def describe(content: bytes | None) -> tuple:
    """The values of `COLUMNS` for the first track with samples."""
    try:
        tracks = read_movie(content or b"")
        track = next((t for t in tracks if len(t.sizes)), tracks[0] if tracks else Track())
        return track.codec, track.seconds, len(track.sizes), [a for a, _ in track.ranges()], [b for _, b in track.ranges()], None
    except (ValueError, struct.error, IndexError) as e:
        return "", 0.0, 0, [], [], str(e)


def media_columns(frame: DataFrame, key: str, content: str) -> DataFrame:
    """key and `COLUMNS` for each row of a binary column of containers."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows = [describe(x.as_py()) for x in part.column(1)]
            kinds = [pa.string(), pa.float64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.string()]
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], [key, *(c.split()[0] for c in COLUMNS.split(", "))])

    return frame.select(key, content).mapInArrow(run, f"{key} {frame.schema[key].dataType.simpleString()}, {COLUMNS}")


def store_texts(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the container of each whole text (null: empty), as `media`."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in batches(parts):
            raw, spans = texts.data.tobytes(), texts.offs.tolist()
            made = [build_movie(padded(raw[a:b])) for a, b in zip(spans, spans[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(texts.offs)), pa.array(made, pa.binary())], ["doc_id", "n_bytes", "media"])

    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


DIGEST = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, codec string, seconds double, n_samples long, n_keyframes long"


def _digest(media: bytes) -> tuple:
    track = read_movie(media)[0]
    payload, ranges = stored(media, track), np.stack([track.offsets[track.keys], track.sizes[track.keys]], 1)
    feature = f"{track.codec.strip()} {track.handler} {track.seconds:.2f}s {len(track.sizes)} samples {len(ranges)} keyframes {ranges[0][0]}+{ranges[0][1]}..{ranges[-1][0]}+{ranges[-1][1]} {zlib.crc32(ranges.astype('<i8').tobytes()):08x}"
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-FRAME:]), len(media), hashlib.sha256(media).hexdigest(), feature, track.codec, track.seconds, len(track.sizes), len(ranges)


def media_digest(stored_texts: DataFrame) -> DataFrame:
    """Reads the containers of `store_texts` back: doc_id and `DIGEST` for each."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.int64(), pa.int64()]
        for part in parts:
            rows = [_digest(x.as_py()) for x in part.column(2)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], ["doc_id", *(c.split()[0] for c in DIGEST.split(", "))])
        trim()

    return stored_texts.mapInArrow(run, f"doc_id {stored_texts.schema['doc_id'].dataType.simpleString()}, {DIGEST}")
