"""Byte-level text helpers shared by the operators, as numpy over Arrow string columns.

A batch's strings lie in one buffer, so splitting, hashing and counting run over the whole
buffer at once. ``pieces`` cuts a batch into runs of whole documents of about ``PIECE``
bytes: the working arrays (8 bytes per text byte) stay small whatever the batch holds.
A document longer than that is a piece of its own and is never cut.

Words are ``[^\\x20\\x09-\\x0D]+`` everywhere. Null texts count as empty.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 2 << 20
U = np.uint64

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_TABLE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_POWERS: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finalizer: spreads every input bit over the word."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) <= n:
        size = max(n + 1, PIECE + 1)
        for i, b in enumerate((_BASE, _INV)):
            p = np.full(size, b, U)
            p[0] = 1
            _POWERS[i] = np.cumprod(p, dtype=U)
    return _POWERS[0], _POWERS[1]


class SpanHash:
    """64-bit hashes of any byte spans of one buffer, from one prefix sum."""

    def __init__(self, buf: np.ndarray):
        n = len(buf)
        up, self.down = _powers(n)
        self.sums = np.zeros(n + 1, U)
        np.cumsum(_TABLE[buf] * up[:n], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (self.sums[end] - self.sums[start]) * self.down[start]
        return mix(raw + (end - start).astype(U) * U(0xD6E8FEB86659FD93))


@dataclass
class Piece:
    """Whole documents ``lo..hi`` of a batch: their bytes and their offsets in them."""

    lo: int
    hi: int
    buf: np.ndarray
    offs: np.ndarray

    @property
    def n(self) -> int:
        return self.hi - self.lo

    def doc_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offs, at, side="right") - 1


def buffers(col) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a string column; a null is an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_binary()), b"")
    offs = np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + len(col) + 1]
    data = col.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[offs[0]:offs[-1]], offs - offs[0]


def pieces(col, size: int = PIECE):
    """Runs of whole documents of about ``size`` bytes (at least one document each)."""
    if len(col) == 0:
        return
    buf, offs = buffers(col)
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + size, side="right")) - 1)
        yield Piece(lo, hi, buf[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo])
        lo = hi


def spans(p: Piece, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes where ``inside`` holds, cut at document ends: (start, end, doc)."""
    n = len(p.buf)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    edge = np.zeros(n + 1, bool)
    edge[p.offs] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return start, end, p.doc_of(start)


def words(p: Piece) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return spans(p, ~SPACE[p.buf])


def per_doc(doc: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    if weights is None:
        return np.bincount(doc, minlength=n)
    return np.bincount(doc, weights=weights, minlength=n).astype(np.int64)


def sums_between(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Number of true flags of each document."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offs[1:]] - total[offs[:-1]]


_FOLD = mix(np.arange(1, 65, dtype=U) * U(0xA0761D6478BD642F)) | U(1)


def shingles(word_hash: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all windows of ``k`` words within a document: (hash, doc, first word)."""
    m = len(word_hash) - k + 1
    if m <= 0:
        return np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = np.zeros(m, U)
    for i in range(k):
        h += word_hash[i:m + i] * _FOLD[i % 64]
    at = np.flatnonzero(doc[:m] == doc[k - 1:])
    return mix(h[at]), doc[at], at


def shingle_sets(word_hash: np.ndarray, doc: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``k``-word shingles of each document, sorted by (doc, hash). A document with
    fewer words (but one at least) has its whole word sequence as its only shingle."""
    h, d, _ = shingles(word_hash, doc, k)
    count = np.bincount(doc, minlength=n)
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        first = np.cumsum(count) - count
        extra = np.zeros(len(short), U)
        for i in range(k - 1):
            has = count[short] > i
            extra[has] += word_hash[first[short[has]] + i] * _FOLD[i]
        extra = mix(extra + count[short].astype(U) * U(0xE7037ED1A0B428DB))
        h, d = np.concatenate([h, extra]), np.concatenate([d, short])
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    return h[new], d[new]
