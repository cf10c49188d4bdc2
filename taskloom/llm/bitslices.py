"""Exact top-k by inner product over a bit-sliced index.

A block of rows holds, for each component of the quantised vectors, one bitmap
for each binary digit (a slice). A query's score for all rows of a block is a
weighted sum of slices: each digit of a query's component adds the component's
slices at its place. The bitmaps of one place are added by carry-save adders,
three to two, over whole stacks at once, until one bitmap is left for each
place. Rows are then selected from the most significant slice downward.

The low slices of the components may be left out of the sum; what they could
add is bounded, and every row within that bound of the k-th is a boundary row,
whose score is taken exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taskloom.llm import _blobs, _words
from taskloom.llm._memory import lean, lean_cogroup, lean_group
from taskloom.llm._store import Workspace, shuffle_width

#: Rows of a block of the index on average, queries that meet a block at once and that are sent together, low slices left out of the sum.
BLOCK_ROWS, BLOCK_QUERIES, PACK, SKIP = 1 << 16, 1 << 16, 1 << 12, 3
#: Lists of best rows of a query that are merged at once.
MERGED = 256


def quantise(vectors: np.ndarray, scale: float = 256.0) -> np.ndarray:
    return np.floor(vectors.astype(np.float64) * scale).astype(np.int64)


class SliceBlock:
    """The slices of a block of quantised rows, in ascending order of their ids."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, skip: int = SKIP):
        order = np.argsort(ids, kind="stable")
        self.ids, self.rows = ids[order], rows[order]
        n, self.dims = self.rows.shape
        self.words = -(-n // 64) if n else 0
        top = int(np.abs(self.rows).max()) if self.rows.size else 0
        self.width = max(top.bit_length() + 1, 2)
        self.skip = min(skip, self.width - 2)
        #: Offset so that all are non-negative; the low slices are left out.
        shifted = self.rows + (1 << (self.width - 1))
        kept = range(self.skip, self.width)
        self.slices = len(kept)
        padded = np.zeros((self.dims * self.slices, self.words * 64), np.uint8)
        for j, place in enumerate(kept):
            padded[j :: self.slices, :n] = ((shifted >> place) & 1).T
        plain = np.packbits(padded, axis=1, bitorder="little").view(np.uint64)
        self._open(plain)

    def _open(self, plain: np.ndarray) -> None:
        #: Slices, then their complements, for digits of minus one.
        self.stack = np.concatenate((plain, ~plain))
        valid = np.zeros(self.words * 64, np.uint8)
        valid[: len(self.ids)] = 1
        self.valid = np.packbits(valid, bitorder="little").view(np.uint64)

    def to_bytes(self) -> bytes:
        """Ids, rows and slices as they are stored."""
        low, high = (int(self.rows.min()), int(self.rows.max())) if self.rows.size else (0, 0)
        rows = self.rows.astype(np.int16) if -32768 <= low and high < 32768 else self.rows
        shape = np.array([self.dims, self.width, self.skip], np.int64)
        return _blobs.pack(shape, self.ids, rows.ravel(), self.stack[: self.dims * self.slices].ravel())

    @classmethod
    def from_bytes(cls, blob: bytes) -> SliceBlock:
        shape, ids, rows, plain = _blobs.unpack(blob)
        self = cls.__new__(cls)
        self.dims, self.width, self.skip = (int(x) for x in shape)
        self.ids, self.rows = ids, rows.astype(np.int64).reshape(len(ids), self.dims)
        self.words, self.slices = -(-len(ids) // 64), self.width - self.skip
        self._open(plain.reshape(self.dims * self.slices, self.words))
        return self

    def _places(self, query: np.ndarray) -> dict[int, np.ndarray]:
        """For each binary place, which bitmaps a query adds there; digits are signed, few of them not 0."""
        out: dict[int, list] = {}
        base = np.arange(self.slices)
        left, place = query.astype(np.int64).copy(), 0
        while left.any():
            odd = left & 1 == 1
            digit = np.where(odd, 2 - (left & 3), 0)
            for sign, shift in ((1, 0), (-1, self.dims * self.slices)):
                d = np.flatnonzero(digit == sign)
                if len(d):
                    for j in base.tolist():
                        out.setdefault(place + j, []).append(d * self.slices + j + shift)
            left = (left - digit) >> 1
            place += 1
        return {p: np.concatenate(v) for p, v in out.items()}

    def _sum(self, query: np.ndarray) -> list[np.ndarray]:
        """The bitmaps of the sum, least place first."""
        places = self._places(query)
        total: list[np.ndarray] = []
        carried: list[np.ndarray] = []
        p = 0
        while carried or any(q >= p for q in places):
            parts = [self.stack[places[p]]] if p in places else []
            parts += carried
            stack = np.concatenate(parts) if parts else np.zeros((1, self.words), np.uint64)
            carried = []
            while len(stack) > 1:
                third = len(stack) // 3
                if third:
                    a, b, c = stack[:third], stack[third : 2 * third], stack[2 * third : 3 * third]
                    half = a ^ b
                    carried.append((a & b) | (half & c))
                    stack = np.concatenate((half ^ c, stack[3 * third :]))
                else:
                    carried.append((stack[0] & stack[1])[None])
                    stack = (stack[0] ^ stack[1])[None]
            total.append(stack[0])
            p += 1
        return total

    def top(self, query: np.ndarray, k: int, own: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best rows but those of id ``own``; ties go to smaller ids."""
        valid = self.valid
        at, end = np.searchsorted(self.ids, own), np.searchsorted(self.ids, own, "right")
        if end > at:
            valid = valid.copy()
            for i in range(at, end):
                valid[i >> 6] &= ~(np.uint64(1) << np.uint64(i & 63))
        count = int(np.bitwise_count(valid).sum())
        if count > 4 * k:
            total = self._sum(query)
            # From the most significant slice down: sure rows, and those that tie with the k-th so far.
            sure, tied, bound = np.zeros_like(valid), valid, 0
            for p in range(len(total) - 1, -1, -1):
                both = sure | (tied & total[p])
                n = int(np.bitwise_count(both).sum())
                if n >= k:
                    tied = tied & total[p]
                    bound |= 1 << p
                else:
                    sure, tied = both, tied & ~total[p]
            # The left-out slices of a component add up to 2^skip - 1 times the query's component, either way.
            reach = ((1 << self.skip) - 1) * int(np.abs(query).sum())
            floor = bound - (-(-reach // (1 << self.skip)))
            near = valid
            if floor > 0:
                above, equal = np.zeros_like(valid), valid
                for p in range(max(len(total), floor.bit_length()) - 1, -1, -1):
                    bit = total[p] if p < len(total) else np.zeros_like(valid)
                    if floor >> p & 1:
                        equal = equal & bit
                    else:
                        above = above | (equal & bit)
                        equal = equal & ~bit
                near = above | equal
            valid = near
        rows = np.flatnonzero(np.unpackbits(valid.view(np.uint8), bitorder="little"))
        score = self.rows[rows] @ query
        order = np.lexsort((rows, -score))[:k]
        return self.ids[rows[order]], score[order]


def _rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return np.asarray(column.flatten()), column.value_lengths().to_numpy(zero_copy_only=False)


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null, and all of it finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & finite, F.lit(False))


def top_k(df: DataFrame, queries: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", scale: float = 256.0) -> DataFrame:
    """(query_id, rank from 1, key, score) of the k rows of highest inner product for each query row.

    Components are quantised to floor(scale * x). ``queries`` says which rows
    are queries; candidates are all rows of other keys, ties go to the smaller
    key. Vectors that are null or hold null or non-finite components,
    and rows with a null key, take no part. Shorter vectors count as padded with zeros, empty ones as all zeros.
    Very long vectors make an index of as many slices a component. Other columns aren't read. Rows that repeat a key are
    candidates each; as queries, the first of their vectors in order stands. With fewer candidates than k, all are
    returned; an empty table gives no rows. Scores are 64-bit integers.
    """
    spark = df.sparkSession
    quantised = F.transform(F.col(vector).cast("array<double>"), lambda x: F.floor(x * F.lit(float(scale))))
    rows = df.where(F.col(key).isNotNull() & usable(F.col(vector))).select(
        F.col(key).cast("long").alias("k"), quantised.alias("v"), F.coalesce(queries, F.lit(False)).alias("q")
    )
    facts = rows.agg(F.count(F.lit(1)), F.sum(F.col("q").cast("long")), F.max(F.size("v"))).first()
    total, asked, dims = facts[0], facts[1] or 0, max(facts[2] or 1, 1)
    out_key = "k" if key in ("query_id", "rank", "score") else key
    if not asked:
        return spark.createDataFrame([], f"query_id long, rank int, `{out_key}` long, score long")
    blocks = max(-(-total // BLOCK_ROWS), min(shuffle_width(spark), total // (BLOCK_ROWS // 4)))
    query_blocks = -(-asked // BLOCK_QUERIES)

    def matrix(column: pa.Array) -> np.ndarray:
        flat, sizes = _rows(column)
        out = np.zeros((len(sizes), dims), np.int64)
        out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
        return out

    def deal(rows_: DataFrame, parts: int) -> DataFrame:
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column("k").to_numpy(zero_copy_only=False)
                values = matrix(batch.column("v"))
                order, ends = _blobs.by_bucket((_words.mix(ids.view(np.uint64)) % np.uint64(parts)).astype(np.int64))
                small = values.astype(np.int16) if len(values) and np.abs(values).max() < 32768 else values
                made = [(g, _blobs.pack(ids[order[a:b]], small[order[a:b]].ravel())) for g, a, b in ends]
                yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.int64()), pa.array([m[1] for m in made], pa.binary())], names=["g", "b"])

        return rows_.select("k", "v").mapInArrow(lean(work), "g long, b binary")

    def join(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        parts = [_blobs.unpack(b) for b in blobs]
        ids = np.concatenate([p[0] for p in parts])
        return ids, np.concatenate([p[1].astype(np.int64) for p in parts]).reshape(len(ids), dims)

    def build(table: pa.Table) -> pa.Table:
        block = SliceBlock(*join(table.column("b").to_pylist()))
        return pa.table({"cb": table.column("cb")[:1], "s": pa.array([block.to_bytes()], pa.binary())})

    asked_rows = rows.where("q").groupBy("k").agg(F.min("v").alias("v"))
    work = Workspace(spark, "bitslices")
    # The slices are built and stored once for each block; queries travel in packs.
    index = work.save(deal(rows, blocks).select(F.col("g").alias("cb"), "b").groupBy("cb").applyInArrow(lean_group(build), "cb long, s binary"), "index")
    packs = -(-asked // PACK)
    questions = work.save(deal(asked_rows, packs).select((F.col("g") % query_blocks).alias("qb"), "b"), "queries")
    # Every query meets every block of the index: the set asked for against all rows. Up to BLOCK_QUERIES
    # of them stream past a block together, so the index travels once for each so many queries.
    left = questions.withColumn("cb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    right = index.withColumn("qb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(query_blocks - 1).cast("long"))))

    def meet(asks: pa.Table, held: pa.Table) -> pa.Table:
        made: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(asks) and len(held):
            block, cb = SliceBlock.from_bytes(held.column("s")[0].as_py()), held.column("cb")[0].as_py()
            for q, v in zip(*join(asks.column("b").to_pylist()), strict=True):
                ids, scores = block.top(v, k, int(q))
                made.append((np.full(len(ids), q), ids, scores))
            columns = [np.concatenate(c) for c in zip(*made, strict=True)]
            return pa.table({**{n: pa.array(c, pa.int64()) for n, c in zip(("query_id", "k", "score"), columns, strict=True)}, "part": pa.array(np.full(len(columns[0]), cb), pa.int64())})
        return pa.table({n: pa.array([], pa.int64()) for n in ("query_id", "k", "score", "part")})

    best = left.groupBy("cb", "qb").cogroup(right.groupBy("cb", "qb")).applyInArrow(lean_cogroup(meet), "query_id long, k long, score long, part long")
    top = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("k").alias("k")))), 1, k)
    parts = blocks
    while parts > 1:
        # Lists of many blocks are merged some at a time, so that none grows with the table.
        parts = -(-parts // MERGED)
        best = best.groupBy("query_id", F.floor(F.col("part") / MERGED).alias("part")).agg(top.alias("t")).select("query_id", "part", F.explode("t").alias("t"))
        best = best.select("query_id", F.col("t.k").alias("k"), (-F.col("t.s")).alias("score"), "part")
    merged = best.groupBy("query_id").agg(top.alias("t")).select("query_id", F.posexplode("t").alias("p", "t"))
    return merged.select("query_id", (F.col("p") + 1).alias("rank"), F.col("t.k").alias(out_key), (-F.col("t.s")).alias("score"))
