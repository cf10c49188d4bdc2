"""Vectorised words and word hashes over the UTF-8 buffers of Arrow string columns.

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D; those separators
are single bytes in UTF-8, so working on bytes gives the same words as working
on code points. Hashes are 64 bits wide and do not depend on batch limits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; a longer text is cut at a separator.
CHUNK_BYTES = 1 << 20

_BYTES = np.arange(256, dtype=np.uint8)
_SEPARATOR = np.isin(_BYTES, np.array([0x20, *range(0x09, 0x0E)], np.uint8))
_LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33 = np.uint64(33)
_MASKS = np.array([(1 << (8 * n)) - 1 for n in range(8)] + [2**64 - 1], np.uint64)


def multipliers(count: int, seed: int = 1) -> np.ndarray:
    """Odd 64-bit multipliers, one for each word position of a window."""
    rng = np.random.Generator(np.random.PCG64(seed))
    return rng.integers(0, 2**64, count, np.uint64) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, in place where the input allows it."""
    x = x ^ (x >> _S33)
    x *= _M1
    x ^= x >> _S33
    x *= _M2
    x ^= x >> _S33
    return x


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets of the texts) of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32, count=len(column) + 1 + column.offset)
    at = at[column.offset :].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def _spans(raw: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the words; texts begin at edges, where a word always ends."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    gap = _SEPARATOR[raw]
    before = np.empty(len(raw) + 1, bool)
    before[0] = before[-1] = True
    before[1:-1] = gap[:-1]
    cut = np.zeros(len(raw) + 1, bool)
    cut[edges] = True
    starts = np.flatnonzero(~gap & (before[:-1] | cut[:-1]))
    gap_after = np.empty(len(raw), bool)
    gap_after[:-1] = gap[1:]
    gap_after[-1] = True
    ends = np.flatnonzero(~gap & (gap_after | cut[1:])) + 1
    return starts, ends


def _hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    size = ends - starts
    h = size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    if not len(starts):
        return h
    padded = np.zeros(len(raw) + 8, np.uint8)
    padded[: len(raw)] = raw
    eights = np.ndarray((len(raw) + 1,), np.dtype("<u8"), padded, strides=(1,))
    h ^= eights[starts] & _MASKS[np.minimum(size, 8)]
    h = mix(h)
    live = np.flatnonzero(size > 8)
    at = 8
    while len(live):
        part = eights[starts[live] + at] & _MASKS[np.minimum(size[live] - at, 8)]
        h[live] = mix((h[live] ^ part) * np.uint64(0x9E3779B97F4A7C15))
        at += 8
        live = live[size[live] > at]
    return h


@dataclass
class Words:
    """Words of consecutive texts: hashes, and where each text's words begin."""

    first: int
    hashes: np.ndarray
    edges: np.ndarray
    tails: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.edges) - 1

    def of(self, i: int) -> np.ndarray:
        return self.hashes[self.edges[i] : self.edges[i + 1]]


def _tails(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number of 24 bits for the last three bytes of each word."""
    out = np.zeros(len(ends), np.uint32)
    for k in (1, 2, 3):
        out = out << np.uint32(8) | np.where(ends - k >= starts, raw[np.maximum(ends - k, 0)], 0)
    return out


def _one(raw: np.ndarray, offsets: np.ndarray, lower: bool, tails: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    raw = _LOWER[raw] if lower else raw
    starts, ends = _spans(raw, offsets)
    return _hashes(raw, starts, ends), np.searchsorted(starts, offsets), _tails(raw, starts, ends) if tails else None


def _long(raw: np.ndarray, lower: bool, tails: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """Hashes and tails of a text over CHUNK_BYTES, piece by piece."""
    out, at = [], 0
    while at < len(raw):
        end = min(at + CHUNK_BYTES, len(raw))
        while end < len(raw) and not _SEPARATOR[raw[end]]:
            step = raw[end : end + CHUNK_BYTES]
            found = np.flatnonzero(_SEPARATOR[step])
            end += int(found[0]) if len(found) else len(step)
        out.append(_one(raw[at:end], np.array([0, end - at]), lower, tails)[::2])
        at = end
    return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out]) if tails else None


def words_of(column: pa.Array, lower: bool = True, tails: bool = False) -> Iterator[Words]:
    """The words of a column's texts, in groups of about CHUNK_BYTES of text.

    ``lower`` folds A-Z only. Null texts have no words. With ``tails``, words
    also have a number for their last three bytes.
    """
    raw, offsets = buffers(column)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + CHUNK_BYTES, "right")) - 1
        j = min(max(j, i + 1), n)
        piece = raw[offsets[i] : offsets[j]]
        if j == i + 1 and len(piece) > CHUNK_BYTES:
            h, last = _long(piece, lower, tails)
            yield Words(i, h, np.array([0, len(h)]), last)
        else:
            yield Words(i, *_one(piece, offsets[i : j + 1] - offsets[i], lower, tails))
        i = j


@dataclass
class Spans:
    """Words of consecutive texts by where they lie in a buffer, with their hashes; edges as in Words."""

    first: int
    raw: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    edges: np.ndarray
    hashes: np.ndarray


def spans_of(column: pa.Array, lower: bool = False, together: int = CHUNK_BYTES) -> Iterator[Spans]:
    """As ``words_of``, with the places of the words, in groups of about so many bytes."""
    raw, offsets = buffers(column)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + together, "right")) - 1
        j = min(max(j, i + 1), n)
        piece, edges = raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        piece = _LOWER[piece] if lower else piece
        parts, at = [], 0
        while at < len(piece) or not parts:
            end = min(at + CHUNK_BYTES, len(piece)) if len(edges) == 2 else len(piece)
            while end < len(piece) and not _SEPARATOR[piece[end]]:
                end += 1
            own = piece[at:end]
            starts, ends = _spans(own, edges if len(edges) > 2 else np.array([0, len(own)]))
            parts.append((starts + at, ends + at, _hashes(own, starts, ends)))
            at = end
            if at >= len(piece):
                break
        starts, ends, hashes = (np.concatenate(x) for x in zip(*parts, strict=True))
        yield Spans(i, piece, starts, ends, np.searchsorted(starts, edges), hashes)
        i = j


def cut_out(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The bytes of spans as a binary column."""
    size = ends - starts
    offsets = np.concatenate(([0], np.cumsum(size)))
    flat = raw[np.repeat(starts - offsets[:-1], size) + np.arange(offsets[-1])]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(flat))])


def distinct(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a place of each different span, which of them each span is), by their bytes and not only by hashes."""
    size = ends - starts
    _, first, which = np.unique(_hashes(raw, starts, ends), return_index=True, return_inverse=True)
    model = first[which]
    same = size == size[model]
    # By eight bytes at a time.
    long = np.flatnonzero(same)
    if len(long):
        padded = np.zeros(len(raw) + 8, np.uint8)
        padded[: len(raw)] = raw
        eights = np.ndarray((len(raw) + 1,), np.dtype("<u8"), padded, strides=(1,))
        at = 0
        while len(long):
            mask = _MASKS[np.minimum(size[long] - at, 8)]
            equal = (eights[starts[long] + at] & mask) == (eights[starts[model[long]] + at] & mask)
            same[long[~equal]] = False
            at += 8
            long = long[equal & (size[long] > at)]
    for i in np.flatnonzero(~same).tolist():
        # Spans whose hash another one has: each stands for itself.
        which[i] = len(first)
        first = np.append(first, i)
    return first, which


def windows(hashes: np.ndarray, size: int, seed: int = 1) -> np.ndarray:
    """Hash of each run of ``size`` consecutive words; empty if there are fewer."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    by = multipliers(size, seed)
    out = hashes[:n] * by[0]
    for k in range(1, size):
        out += hashes[k : k + n] * by[k]
    return mix(out)


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of a text's shingles; with fewer words, the whole sequence is one."""
    if 0 < len(hashes) < size:
        return windows(hashes, len(hashes)) ^ np.uint64(len(hashes))
    return windows(hashes, size)


def shingle_sets(group: Words, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text of a group."""
    inner = windows(group.hashes, size)
    out = []
    for a, b in zip(group.edges[:-1].tolist(), group.edges[1:].tolist(), strict=True):
        if b - a >= size:
            s = np.sort(inner[a : b - size + 1])
            if len(s) > 1:
                s = s[np.concatenate(([True], s[1:] != s[:-1]))]
            out.append(s)
        else:
            out.append(shingles(group.hashes[a:b], size))
    return out
