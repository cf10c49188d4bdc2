"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A text is escaped as the library does it (one space in front, spaces as "▁")
and split where a piece can't reach: before a run of spaces. Distinct stretches
are encoded together in flat numpy arrays of symbols. In a round every stretch
finds the least rank among its pairs by a segmented minimum, all its leftmost
non-overlapping pairs of that rank merge at once, and the arrays are compacted;
stretches without a pair leave. Rounds go on until none remains.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from taskloom.llm import _words
from taskloom.llm._memory import lean

_SPACE = "▁"
#: Bytes of text encoded together; a longer text is cut before a run of spaces.
GROUP_BYTES = 1 << 20
#: Rows that are given back at once.
_ROWS = 512
_BITS = 21
_NONE = np.int64(2**62)


class PieceModel:
    """Tables of a BPE model with byte fallback, built from the bytes of its file."""

    def __init__(self, proto: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        self.size = n = sp.vocab_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        number = {p: i for i, p in enumerate(pieces)}
        if any(sp.is_unused(i) for i in range(n)) or not all(f"<0x{b:02X}>" in number for b in range(256)):
            raise ValueError("models with unused pieces or without byte fallback aren't supported")
        if any(_SPACE in pieces[i].lstrip(_SPACE) for i in plain):
            raise ValueError("pieces that reach over a space aren't supported")
        self.byte_ids = [number[f"<0x{b:02X}>"] for b in range(256)]
        ids = {pieces[i]: i for i in plain}
        #: Symbols: ids, then characters of pieces that are no pieces, then self.base + code point.
        symbols = dict(ids)
        for p in list(ids):
            for c in p:
                symbols.setdefault(c, n + len(symbols) - len(ids))
        self.base = max(symbols.values()) + 1
        self.of_char = np.arange(0x110000, dtype=np.int64) + self.base
        for p, s in symbols.items():
            if len(p) == 1:
                self.of_char[ord(p)] = s
        self.text = {s: p for p, s in symbols.items()}
        scores = np.array([sp.get_score(i) for i in plain])
        rank = dict(zip(plain, np.unique(-scores, return_inverse=True)[1].tolist(), strict=True))
        keys, ranks, made = [], [], []
        for p, i in ids.items():
            for k in range(1, len(p)):
                a, b = symbols.get(p[:k]), symbols.get(p[k:])
                if a is not None and b is not None:
                    keys.append(a << _BITS | b)
                    ranks.append(rank[i])
                    made.append(i)
        self.ranks = np.array([*ranks, _NONE], np.int64)
        self.made = np.array([*made, 0], np.int64)
        self._pairs = _Pairs(np.array(keys, np.int64))
        self.longest = max(map(len, ids))
        #: Pieces that, once made, may take part in a pair of a lesser rank: such merges are done one by one.
        self.early = np.zeros(self.base, bool)
        for key, r in zip(keys, ranks, strict=True):
            for s in (key >> _BITS, key & (1 << _BITS) - 1):
                if s in rank and rank[s] >= r:
                    self.early[s] = True
        self.bytes_of = np.array(self.byte_ids, np.int32)
        decoded = [b""] * n
        for i in plain:
            decoded[i] = pieces[i].replace(_SPACE, " ").encode()
        for b, i in enumerate(self.byte_ids):
            decoded[i] = bytes([b])
        self._decoded = _Table(decoded)
        self._decimals = _Table([f"{i},".encode() for i in range(n)])

    def _lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = self._pairs.find(left << _BITS | right)
        return self.ranks[at], self.made[at]

    def merge(self, points: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbols of all stretches one after the other, how many each has) from their code points."""
        symbols = self.of_char[points]
        who = np.arange(len(size))
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        last = np.zeros(len(symbols), bool)
        last[np.cumsum(size) - 1] = True
        rank = np.full(len(symbols), _NONE)
        made = np.zeros(len(symbols), np.int64)
        inner = np.flatnonzero(~last)
        rank[inner], made[inner] = self._lookup(symbols[inner], symbols[inner + 1])
        while len(symbols):
            starts = np.cumsum(size) - size
            least = np.minimum.reduceat(rank, starts)
            over = least >= _NONE
            if over.any():
                gone = np.repeat(over, size)
                done.append((who[over], size[over], symbols[gone]))
                stay = ~gone
                symbols, rank, made, last = symbols[stay], rank[stay], made[stay], last[stay]
                who, size, least = who[~over], size[~over], least[~over]
                if not len(symbols):
                    break
            hits = np.flatnonzero(rank == np.repeat(least, size))
            word = np.searchsorted(np.cumsum(size), hits, "right")
            gap = np.diff(hits, prepend=-(10**9))
            new_word = np.diff(word, prepend=-1) > 0
            # In a run of overlapping pairs every second one merges, from the left.
            run_at = np.flatnonzero((gap > 1) | new_word)
            offset = np.arange(len(hits)) - np.repeat(run_at, np.diff(np.append(run_at, len(hits))))
            pick = (offset % 2 == 0) & (~self.early[made[hits]] | new_word | (gap > 2 * self.longest + 2))
            at = hits[pick]
            symbols[at] = made[at]
            last[at] = last[at + 1]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            size = size - np.bincount(word[pick], minlength=len(size))
            at = at - np.arange(len(at))
            symbols, rank, made, last = symbols[keep], rank[keep], made[keep], last[keep]
            rank[at[last[at]]] = _NONE
            fresh = np.concatenate((at[~last[at]], at[at > 0] - 1))
            fresh = fresh[~last[fresh]]
            rank[fresh], made[fresh] = self._lookup(symbols[fresh], symbols[fresh + 1])
        who = np.concatenate([d[0] for d in done]) if done else np.zeros(0, np.int64)
        sizes = np.concatenate([d[1] for d in done]) if done else np.zeros(0, np.int64)
        flat = np.concatenate([d[2] for d in done]) if done else np.zeros(0, np.int64)
        out = np.empty(len(sizes), np.int64)
        out[who] = sizes
        target = np.cumsum(out) - out
        place = np.repeat(target[who] - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(flat))
        symbols = np.empty(len(flat), np.int64)
        symbols[place] = flat
        return symbols, out

    def _finished(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids for symbols; characters that are no piece become their bytes."""
        rare = np.flatnonzero(symbols >= self.size)
        if not len(rare):
            return symbols.astype(np.int32), sizes
        text = "".join([self.text[s] if s < self.base else chr(s - self.base) for s in symbols[rare].tolist()])
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        width = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
        times = np.ones(len(symbols), np.int64)
        times[rare] = width
        out = np.repeat(symbols, times).astype(np.int32)
        first = np.cumsum(times) - times
        at = np.repeat(first[rare] - (np.cumsum(width) - width), width) + np.arange(width.sum())
        out[at] = self.bytes_of[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)]
        return out, np.add.reduceat(times, np.cumsum(sizes) - sizes)

    def _group(self, raw: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, where each part's begin) of the parts of a buffer, each of which begins with a space."""
        space = raw == 0x20
        begins = space.copy()
        begins[1:] &= ~space[:-1]
        begins[edges[:-1]] = True
        starts = np.flatnonzero(begins)
        ends = np.append(starts[1:], len(raw))
        first, which = _words.distinct(raw, starts, ends)
        a, length = starts[first], (ends - starts)[first]
        flat = raw[np.repeat(a - (np.cumsum(length) - length), length) + np.arange(length.sum())]
        points = np.frombuffer(flat.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        chars = np.add.reduceat((flat & 0xC0) != 0x80, np.cumsum(length) - length, dtype=np.int64)
        points = np.where(points == 0x20, np.uint32(ord(_SPACE)), points)
        ids, sizes = self._finished(*self.merge(points, chars))
        begin = np.cumsum(sizes) - sizes
        n = sizes[which]
        total = np.cumsum(n)
        out = ids[np.repeat(begin[which] - (total - n), n) + np.arange(int(n.sum()))]
        stretch = np.searchsorted(starts, edges)
        return out, np.concatenate(([0], total))[stretch]

    def encode_column(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(texts, ids, where each text's ids begin), in order; a long text comes in several parts."""
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        texts = pc.replace_substring(texts, _SPACE, " ")
        filled = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string()))
        raw, offsets = _words.buffers(pc.if_else(pc.equal(texts, ""), texts, filled))
        parts: list[tuple[int, int, int]] = []
        size = 0
        for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
            while a < b:
                end = b
                if b - a > GROUP_BYTES:
                    end = a + GROUP_BYTES
                    while end < b and not (raw[end] == 0x20 and raw[end - 1] != 0x20):
                        end += 1
                parts.append((i, a, end))
                size += end - a
                a = end
                if size >= GROUP_BYTES:
                    yield self._parts(raw, parts)
                    parts, size = [], 0
        if parts:
            yield self._parts(raw, parts)

    def _parts(self, raw: np.ndarray, parts: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        # Empty texts lie between parts without bytes of their own, so the parts are one stretch of the buffer.
        first = parts[0][1]
        edges = np.array([p[1] for p in parts] + [parts[-1][2]]) - first
        ids, begin = self._group(raw[first : parts[-1][2]], edges)
        return np.array([p[0] for p in parts]), ids, begin

    def encode(self, text: str) -> list[int]:
        return [int(i) for _, ids, _ in self.encode_column(pa.array([text], pa.large_string())) for i in ids]

    def decode_bytes(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the bytes that ids stand for, where each id's begin), with the space put in front of a text."""
        return self._decoded.join(ids)

    def decimals(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids in decimals, each with a comma after it, where each id's begin)."""
        return self._decimals.join(ids)

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids; the one space put in front is taken off, control ids stand for nothing."""
        raw = self.decode_bytes(np.fromiter(ids, np.int64))[0].tobytes()
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


class _Pairs:
    """Places of keys by two hash tables: the second has the few keys whose slot in the first is taken."""

    def __init__(self, keys: np.ndarray, bits: int = 20):
        self.shift = np.uint64(64 - bits)
        self.tables: list[tuple[np.uint64, np.ndarray, np.ndarray]] = []
        self.none = len(keys)
        left, rng = np.arange(len(keys)), np.random.Generator(np.random.PCG64(5))
        while len(left) or not self.tables:
            by = rng.integers(0, 2**63, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
            slot = self._slot(keys[left], by)
            _, first = np.unique(slot, return_index=True)
            if self.tables and len(first) < len(left):
                continue
            held, place = np.full(1 << bits, -1, np.int64), np.full(1 << bits, self.none, np.int32)
            held[slot[first]], place[slot[first]] = keys[left[first]], left[first]
            self.tables.append((by, held, place))
            left = np.delete(left, first)

    def _slot(self, keys: np.ndarray, by: np.uint64) -> np.ndarray:
        return (keys.astype(np.uint64) * by >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), self.none, np.int32)
        for by, held, place in self.tables:
            slot = self._slot(keys, by)
            hit = held[slot] == keys
            out[hit] = place[slot[hit]]
        return out


class _Table:
    """Byte strings by number, joined by gathering from one buffer."""

    def __init__(self, strings: list[bytes]):
        self.raw = np.frombuffer(b"".join(strings), np.uint8)
        self.size = np.array([len(s) for s in strings], np.int32)
        self.begin = (np.cumsum(self.size) - self.size).astype(np.int32)

    def join(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = self.size[numbers]
        edges = np.zeros(len(numbers) + 1, np.int64)
        np.cumsum(size, out=edges[1:])
        shift = self.begin[numbers] - edges[:-1].astype(np.int32)
        at = np.repeat(shift, size)
        at += np.arange(len(at), dtype=np.int32)
        return self.raw[at], edges


@functools.lru_cache(maxsize=2)
def loaded(model: bytes) -> PieceModel:
    """The tables of a model's file; a worker builds them once, whatever its number of tasks."""
    return PieceModel(model)


def encode(df: DataFrame, model: bytes, text: str = "text", ids: str = "ids", decoded: str | None = None, digests: bool = False) -> DataFrame:
    """Adds the piece ids of each text and, if named, the text decoded from them.

    With ``digests`` the added columns are ``n_tokens``, ``ids_sha256`` (of the
    decimal ids joined by commas) and ``decoded_sha256`` instead. Null and
    empty texts have no ids and decode to the empty text; very long ones are encoded whole, part by part. Rows that repeat get
    the same ids each; pairs of pieces that tie in rank merge from the left, as in the library. An empty table stays empty. Columns named as an
    added one are replaced; all others are kept as they are.
    """
    fields = {
        True: [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())],
        False: [(ids, T.ArrayType(T.IntegerType(), False)), *([(decoded, T.StringType())] if decoded else [])],
    }[digests]
    names = [n for n, _ in fields]
    kept = [c for c in df.columns if c not in names]
    schema = T.StructType([*df.select(*kept).schema.fields, *[T.StructField(n, t) for n, t in fields]])
    source = df.select(*kept) if text in kept else df.select(*kept, text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = loaded(model)
        for batch in (whole.slice(i, _ROWS) for whole in batches for i in range(0, whole.num_rows, _ROWS)):
            rows = batch.num_rows
            counts = np.zeros(rows, np.int64)
            shas = [(hashlib.sha256(), hashlib.sha256()) for _ in range(rows)] if digests else []
            flat: list[np.ndarray] = []
            texts: list[list[bytes]] = [[] for _ in range(rows)]
            for of, found, begin in tables.encode_column(batch.column(text)):
                decimals, d_at = tables.decimals(found) if digests else (None, None)
                plain, p_at = tables.decode_bytes(found) if digests or decoded else (None, None)
                for i, a, b in zip(of.tolist(), begin[:-1].tolist(), begin[1:].tolist(), strict=True):
                    fresh = counts[i] == 0
                    counts[i] += b - a
                    if digests:
                        shas[i][0].update(b"" if fresh else b",")
                        shas[i][0].update(decimals[d_at[a] : d_at[b] - 1])
                        shas[i][1].update(plain[p_at[a] + fresh : p_at[b]])
                    elif decoded:
                        texts[i].append(plain[p_at[a] + fresh : p_at[b]].tobytes())
                if not digests:
                    flat.append(found)
            if digests:
                new = [pa.array(counts), *[pa.array([h[j].hexdigest() for h in shas], pa.string()) for j in (0, 1)]]
            else:
                edges = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
                new = [pa.ListArray.from_arrays(pa.array(edges), pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int32), pa.int32()))]
                if decoded:
                    new.append(pa.array([b"".join(t).decode() for t in texts], pa.string()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *new], names=[*kept, *names])

    return source.mapInArrow(lean(work), schema)
