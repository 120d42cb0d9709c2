"""Vectorised word and byte features over the buffers of Arrow string columns.

Every function works on a `Texts`: the concatenated UTF-8 bytes of some whole documents and
their offsets. Nothing here loops over characters or words in Python.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Fingerprints are polynomials modulo a prime, so that no family of texts collides by its structure.
PRIME = (1 << 61) - 1
_BASE = 0x1E3779B97F4A7C15 % PRIME
_INVERSE = pow(_BASE, -1, PRIME)
_P, _LOW32, _LOW29 = U(PRIME), U(0xFFFFFFFF), U((1 << 29) - 1)
#: Words are maximal runs of bytes that are not U+0020 or U+0009 to U+000D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of whole documents that are worked on at a time (a longer document is alone).
CHUNK = 1 << 19
#: Powers are kept for so many places; later places take the power of their segment in addition.
SEGMENT = 1 << 19
#: Bytes of a short word: so many residues, and one that is folded, add up below 2^64.
SHORT = 15
#: Places that are worked on at a time, so that what is between stays in a core's cache; it divides a segment.
_RUN = 1 << 13


def _fold(x: np.ndarray) -> np.ndarray:
    """x modulo the prime."""
    x = (x & _P) + (x >> U(61))
    return np.minimum(x, x - _P)


def _times(a: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """a times (high * 2^32 + low) modulo the prime; all below the prime."""
    ah, al = a >> U(32), a & _LOW32
    middle = ah * low + al * high
    last = al * low
    return _fold(((ah * high) << U(3)) + (middle >> U(29)) + ((middle & _LOW29) << U(32)) + (last & _P) + (last >> U(61)))


def _halves(x: int | np.ndarray) -> tuple:
    return (U(x >> 32), U(x & 0xFFFFFFFF)) if isinstance(x, int) else (x >> U(32), x & _LOW32)


@cache
def _powers(base: int) -> tuple[np.ndarray, np.ndarray]:
    """The halves of the first `SEGMENT` powers."""
    out = np.ones(SEGMENT, U)
    n = 1
    while n < SEGMENT:
        out[n : 2 * n] = _times(out[:n], *_halves(pow(base, n, PRIME)))
        n *= 2
    high, low = _halves(out)
    return high.astype(np.uint32), low.astype(np.uint32)


@cache
def _letters() -> np.ndarray:
    """What each byte adds to a polynomial at each place of a short word."""
    return np.array([[(b + 1) * pow(_BASE, j, PRIME) % PRIME for b in range(256)] for j in range(SHORT)], U)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit integers."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


class Texts:
    """Some whole documents: `data` (their bytes) and `offs` (n + 1 offsets into it)."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        self.data, self.offs, self.n = data, offs, len(offs) - 1
        self._prefix: np.ndarray | None = None

    @property
    def prefix(self) -> np.ndarray:
        """The polynomials of the bytes before each place, modulo the prime."""
        if self._prefix is None:
            n = len(self.data)
            out, carry = np.zeros(n + 1, U), 0
            high, low = _powers(_BASE)
            for a in range(0, n, _RUN):
                part, at = self.data[a : a + _RUN].astype(U), a % SEGMENT
                part += U(1)
                upper, lower = np.cumsum(part * high[at : at + len(part)]), np.cumsum(part * low[at : at + len(part)])
                lower += upper >> U(29)
                upper &= _LOW29
                upper <<= U(32)
                here = _fold(upper + lower)
                if a >= SEGMENT:
                    here = _times(here, *_halves(pow(_BASE, a - at, PRIME)))
                here += U(carry)
                out[a + 1 : a + 1 + len(part)] = here = _fold(here)
                carry = int(here[-1])
            self._prefix = out
        return self._prefix

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit fingerprints of the byte ranges; equal bytes have equal ones at any place.

        Unequal ranges of n bytes agree with a probability of about n / 2^61.
        """
        p, n = self.prefix, len(self.data)
        high, low = _powers(_INVERSE)
        far = np.array([pow(_INVERSE, k, PRIME) for k in range(0, n + 1, SEGMENT)], U) if n > SEGMENT else None
        found = np.empty(len(starts), U)
        for i in range(0, len(starts), _RUN):
            a, b = starts[i : i + _RUN], ends[i : i + _RUN]
            place = a % SEGMENT
            out = _times(_fold(p[b] + (_P - p[a])), high[place], low[place])
            if far is not None:
                out = _times(out, *_halves(far[a // SEGMENT]))
            found[i : i + _RUN] = mix(out + (b - a).astype(U) * U(0x9E3779B97F4A7C15))
        return found

    def word_hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """As `hashes`, for ranges of which most are short: their bytes are looked up, longest range first, without a `prefix`."""
        size = ends - starts
        order = np.argsort((SHORT + 1 - np.minimum(size, SHORT + 1)).astype(np.uint8), kind="stable")
        long = int((size > SHORT).sum())
        found, letters = np.empty(len(starts), U), _letters()
        if long:
            a, n = starts[order[:long]], size[order[:long]]
            offs = np.zeros(long + 1, np.int64)
            np.cumsum(n, out=offs[1:])
            apart = Texts(self.data[np.repeat(a - offs[:-1], n) + np.arange(offs[-1])], offs)
            found[order[:long]] = apart.hashes(offs[:-1], offs[1:])
        for i in range(long, len(order), _RUN):
            here = order[i : i + _RUN]
            n, a = size[here], starts[here]
            out = np.zeros(len(here), U)
            for j, k in enumerate(len(n) - np.cumsum(np.bincount(n))[:-1]):
                out[:k] += letters[j].take(self.data.take(a[:k]))
                a += 1
                if j == SHORT // 2:
                    out[:k] = _fold(out[:k])
            found[here] = mix(_fold(out) + n.astype(U) * U(0x9E3779B97F4A7C15))
        return found

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the words, and n + 1 offsets of each document's words in them."""
        solid = ~SPACE[self.data]
        first = np.zeros(len(self.data) + 1, bool)
        first[self.offs] = True
        start = solid.copy()
        start[1:] &= ~solid[:-1] | first[1:-1]
        end = solid
        end[:-1] &= ~solid[1:] | first[1:-1]
        starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
        return starts, ends, np.searchsorted(starts, self.offs)

    def sums(self, flags: np.ndarray) -> np.ndarray:
        """For each document the sum of the flags at its bytes."""
        return span_sums(flags, self.offs)


def windows_of_32(data: np.ndarray) -> np.ndarray:
    """64-bit fingerprints of every 32 bytes in a row, from those of 8 and 16."""
    n = len(data) - 31
    if n <= 0:
        return np.zeros(0, U)
    data = np.ascontiguousarray(data)
    eight = np.empty(n + 24, U)
    for k in range(8):
        count = len(eight[k::8])
        eight[k::8] = data[k : k + 8 * count].view("<u8")
    eight *= U(0x9E3779B97F4A7C15)
    eight ^= eight >> U(29)
    pair = eight[:-8] * U(0xC2B2AE3D27D4EB4F) + eight[8:]
    pair ^= pair >> U(32)
    pair *= U(0x165667B19E3779F9)
    pair ^= pair >> U(29)
    return mix(pair[:-16] * U(0xD6E8FEB86659FD93) + pair[16:])


def span_sums(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    kind = np.float64 if values.dtype.kind == "f" else np.int64
    total = np.zeros(len(values) + 1, kind)
    np.cumsum(values, out=total[1:])
    return total[offs[1:]] - total[offs[:-1]]


def shingles(words: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of each k consecutive words of a document, and the documents' offsets.

    A document of fewer than k words, but at least one, has one shingle of all its words.
    """
    counts = np.diff(offs)
    many = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    out = np.zeros(len(many) + 1, np.int64)
    np.cumsum(many, out=out[1:])
    owner = np.repeat(np.arange(len(many)), many)
    at = np.arange(out[-1]) - out[owner] + offs[owner]
    h = np.zeros(len(at), U)
    padded = np.concatenate([words, np.zeros(k, U)])
    for i in range(k):
        inside = at + i < offs[owner + 1]
        h = h * U(0xD6E8FEB86659FD93) + np.where(inside, padded[at + i], U(0))
    return mix(h ^ np.minimum(counts, k)[owner].astype(U)), out


def texts_of(column: pa.Array) -> Texts:
    """The texts of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if offsets and len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return Texts(raw[offs[0] : offs[-1]], offs - offs[0])


def pieces(texts: Texts, limit: int = CHUNK) -> Iterator[tuple[int, int, Texts]]:
    """Runs of documents of at most `limit` bytes, or one longer document: (from, to, texts)."""
    i = 0
    while i < texts.n:
        j = max(i + 1, int(np.searchsorted(texts.offs, texts.offs[i] + limit, side="right")) - 1)
        a, b = texts.offs[i], texts.offs[j]
        yield i, j, Texts(texts.data[a:b], texts.offs[i : j + 1] - a)
        i = j


def trim() -> None:
    """Gives free memory back to the system at the end of a task; else idle Python workers keep it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def batches(frames: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """Slices of the record batches with their texts, each of bounded size."""
    for frame in frames:
        for i, j, part in pieces(texts_of(frame.column(frame.schema.get_field_index(column))), limit):
            yield frame.slice(i, j - i), part
    trim()
