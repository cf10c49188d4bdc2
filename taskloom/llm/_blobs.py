"""Packed records for shuffles: a row is a bucket and one binary holding many records' columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def pack(*columns: np.ndarray) -> bytes:
    """Columns of any lengths, each stored whole, in its own little-endian type."""
    head = np.array([len(columns), *[x for c in columns for x in (c.dtype.num, c.nbytes)]], np.uint32)
    return b"".join([head.tobytes(), *[np.ascontiguousarray(c).tobytes() for c in columns]])


def unpack(blob: bytes) -> list[np.ndarray]:
    n = int(np.frombuffer(blob, np.uint32, 1)[0])
    head = np.frombuffer(blob, np.uint32, 2 * n, 4)
    at, out = 4 + 8 * n, []
    for kind, size in zip(head[::2].tolist(), head[1::2].tolist(), strict=True):
        dtype = np.dtype(_TYPES[kind])
        out.append(np.frombuffer(blob, dtype, size // dtype.itemsize, at))
        at += size
    return out


def squeeze(blob: bytes, level: int = 1) -> bytes:
    """Compressed harder than a shuffle does by itself; its size goes before it."""
    return len(blob).to_bytes(8, "little") + pa.Codec("zstd", level).compress(blob, asbytes=True)


def unsqueeze(blob: bytes) -> bytes:
    return pa.Codec("zstd").decompress(memoryview(blob)[8:], int.from_bytes(blob[:8], "little"), asbytes=True)


_TYPES = {np.dtype(t).num: t for t in (np.uint8, np.uint16, np.uint32, np.uint64, np.int8, np.int16, np.int32, np.int64, np.float32, np.float64)}


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Run-length code of a column: values and counts."""
    if not len(values):
        return values, np.zeros(0, np.uint32)
    at = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
    return values[at], np.diff(np.append(at, len(values))).astype(np.uint32)


def small(values: np.ndarray) -> np.ndarray:
    """Non-negative integers in the least type of 1, 2, 4 or 8 bytes that holds them."""
    top = int(values.max()) if len(values) else 0
    kind = np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64
    return values.astype(kind)


def by_bucket(buckets: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """(stable order by bucket, [(bucket, from, to)] in that order)."""
    top = int(buckets.max()) if len(buckets) else 0
    order = np.argsort(buckets.astype(np.uint16) if top < 1 << 16 else buckets, kind="stable")
    ids, counts = runs(buckets[order])
    ends = np.cumsum(counts).tolist()
    return order, [(int(b), e - int(n), e) for b, n, e in zip(ids.tolist(), counts.tolist(), ends, strict=True)]
