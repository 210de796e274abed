"""Vectorised text primitives shared by the training-data operators.

Everything works on *chunks*: runs of whole documents whose UTF-8 bytes lie in
one flat ``uint8`` array.  Words are maximal runs of bytes outside
``[\\x20\\x09-\\x0D]``; each gets a 64-bit hash computed from its bytes without a
Python loop.  A chunk holds at most ``CHUNK_BYTES`` of text (one longer document
makes a chunk of its own), which bounds a worker's memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 2 << 20

_BASE = np.uint64(0xD1342543DE82EF95)
_GRAM = np.uint64(0x9E3779B97F4A7C15)
#: Bytes that are letters, digits or no ASCII.
_SOLID = np.array([x >= 128 or chr(x).isalnum() for x in range(256)])
_powers = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def base_powers(n: int) -> np.ndarray:
    """The first n powers of the byte base, kept between calls."""
    global _powers
    if len(_powers) < n:
        size = 1 << (n - 1).bit_length()
        steps = np.full(size, _BASE, np.uint64)
        steps[0] = 1
        _powers = np.cumprod(steps, dtype=np.uint64)
    return _powers


def power(base: np.uint64, n: int) -> np.uint64:
    return np.uint64(pow(int(base), n, 1 << 64))


def span_hash(buf: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans of buf, which may not overlap and must be in order."""
    if not len(start):
        return np.zeros(0, np.uint64)
    first = np.zeros(len(start), np.int64)
    np.cumsum(length[:-1], out=first[1:])
    within = np.arange(int(length.sum()), dtype=np.int64) - np.repeat(first, length)
    picked = buf[within + np.repeat(start, length)]
    powers = base_powers(int(length.max()) + 1)
    terms = powers[within]
    terms *= picked.astype(np.uint64) + np.uint64(1)
    full = length > 0
    out = np.zeros(len(start), np.uint64)
    if full.any():
        out[full] = np.add.reduceat(terms, first[full])
    return mix(out + length.astype(np.uint64) * _GRAM)


@dataclass
class Chunk:
    """Whole documents: rows [row0, row0 + n) of an Arrow batch."""

    row0: int
    buf: np.ndarray  # uint8, the documents' bytes one after another
    doc_start: np.ndarray  # int64, n + 1 byte offsets into buf
    null: np.ndarray  # bool per document

    @property
    def n(self) -> int:
        return len(self.doc_start) - 1

    def text(self, i: int) -> bytes:
        return self.buf[self.doc_start[i] : self.doc_start[i + 1]].tobytes()


@dataclass
class Words:
    start: np.ndarray  # byte offset of each word
    end: np.ndarray
    doc: np.ndarray  # document of each word
    doc_word: np.ndarray  # n + 1 word offsets of the documents
    hash: np.ndarray | None

    def __len__(self) -> int:
        return len(self.start)

    def left(self) -> np.ndarray:
        """Words from each word to its document's end, itself included."""
        return self.doc_word[self.doc + 1] - np.arange(len(self.start))


def chunks(column: pa.Array | pa.ChunkedArray, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Cuts a string or binary column into chunks; nulls read as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return
    null = pc.is_null(column).to_numpy(zero_copy_only=False)
    if null.any():
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, side="right")) - 1)
        j = min(j, len(column))
        yield Chunk(i, whole[at[i] : at[j]], at[i : j + 1] - at[i], null[i:j])
        i = j


def words(c: Chunk, hashed: bool = True, lower: bool = False, trim: bool = False) -> Words:
    """The words of a chunk.  In the hashes, lower counts A-Z as a-z, and trim
    leaves out ASCII punctuation at either end of a word that has anything else."""
    b = c.buf
    keep = (b != 32) & ((b < 9) | (b > 13))
    edge = np.zeros(len(b) + 1, bool)
    edge[c.doc_start] = True
    before = np.empty(len(b), bool)
    before[:1] = False
    before[1:] = keep[:-1]
    start = np.flatnonzero(keep & (~before | edge[:-1]))
    after = np.empty(len(b), bool)
    after[-1:] = False
    after[:-1] = keep[1:]
    end = np.flatnonzero(keep & (~after | edge[1:])) + 1
    doc_word = np.searchsorted(start, c.doc_start)
    doc = np.repeat(np.arange(c.n), np.diff(doc_word))
    h = None
    if hashed:
        if lower:
            b = np.where((b >= 65) & (b <= 90), b + np.uint8(32), b)
        left, right = _trimmed(b, start, end) if trim else (start, end)
        h = span_hash(b, left, right - left)
    return Words(start, end, doc, doc_word, h)


def _trimmed(b: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    solid = np.flatnonzero(_SOLID[b])
    if not len(solid):
        return start, end
    i = np.searchsorted(solid, start)
    j = np.searchsorted(solid, end) - 1
    some = i <= j
    return np.where(some, solid[np.minimum(i, len(solid) - 1)], start), np.where(some, solid[j] + 1, end)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every k consecutive entries of h (not cut at documents), by doubling."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    done, size, block, block_size, rest = None, 0, h, 1, k
    while rest:
        if rest & 1:
            done = block if done is None else done[: len(h)] * power(_GRAM, block_size) + _shift(block, size, len(done))
            size += block_size
        rest >>= 1
        if rest:
            block = block * power(_GRAM, block_size) + _shift(block, block_size, len(block))
            block_size *= 2
    return mix(done[:n] + np.uint64(k))


def _shift(x: np.ndarray, by: int, n: int) -> np.ndarray:
    out = np.zeros(n, np.uint64)
    if by < len(x):
        part = x[by : by + n]
        out[: len(part)] = part
    return out


def char_flags(buf: np.ndarray, chars: str) -> np.ndarray:
    """True at each byte that is one of the ASCII characters."""
    table = np.zeros(256, bool)
    table[list(chars.encode())] = True
    return table[buf]


def segment_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values over [bounds[i], bounds[i + 1])."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def points(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, value) of each code point: its UTF-8 bytes as one number."""
    start = np.flatnonzero((buf & 0xC0) != 0x80)
    size = np.diff(np.append(start, len(buf)))
    value = buf[start].astype(np.uint64)
    for k in range(1, int(size.max()) if len(size) else 0):
        more = size > k
        value[more] = value[more] << np.uint64(8) | buf[start[more] + k]
    return start, value


def code_points(c: Chunk, w: Words) -> np.ndarray:
    """Code points inside words, for each document."""
    lead = (c.buf & 0xC0) != 0x80
    inside = np.zeros(len(c.buf) + 1, np.int32)
    np.add.at(inside, w.start, 1)
    np.add.at(inside, w.end, -1)
    return segment_sums(lead & (np.cumsum(inside[:-1]) > 0), c.doc_start)
