"""Document fingerprints: bottom-k sketches of shingle hashes.

A sketch is the sorted k least distinct hashes of a text's word shingles. The
sketch of several parts together is the k least of their sketches' union, so
parts may be sketched apart and merged in any order. Two sketches estimate
resemblance (intersection over union), containment and distinct counts.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type

from taskloom.llm import _words
from taskloom.llm._memory import lean
from taskloom.llm._store import shuffle_width

K, SHINGLE = 128, 5
#: Bytes of text of a range of keys, and ranges at most: a range is read as a stream, so its size is no matter of memory.
RANGE_BYTES, MOST_RANGES = 64 << 20, 1 << 14


def bottom_k(hashes: np.ndarray, k: int = K) -> np.ndarray:
    """The sorted k least distinct hashes."""
    if len(hashes) > 8 * k:
        # Distinct ones among the least are enough unless nearly all repeat.
        least = np.unique(np.partition(hashes, 4 * k)[: 4 * k + 1])
        if len(least) > k:
            return least[:k]
    return np.unique(hashes)[:k]


def merge(sketches: list[np.ndarray], k: int = K) -> np.ndarray:
    """The sketch of all parts together."""
    return np.unique(np.concatenate(sketches))[:k] if sketches else np.zeros(0, np.uint64)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard index; 1 for two texts without words, 0 if only one has any."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.sort(np.concatenate((a, b)))
    same = both[1:] == both[:-1]
    distinct = np.concatenate(([True], ~same))
    last = np.searchsorted(np.cumsum(distinct), min(k, int(distinct.sum())))
    limit = both[min(last, len(both) - 1)]
    shared = int((same & (both[1:] <= limit)).sum())
    return shared / min(k, int(distinct.sum()))


def distinct_count(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact below k."""
    return float(len(a)) if len(a) < k else (k - 1) / ((float(a[k - 1]) + 1) / 2.0**64)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has as well."""
    if not len(a):
        return 1.0
    shared = resemblance(a, b, k) * distinct_count(merge([a, b], k), k)
    return min(1.0, shared / distinct_count(a, k))


def to_text(sketch: np.ndarray) -> str:
    return base64.b64encode(sketch.astype(">u8").tobytes()).decode()


def from_text(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), ">u8").astype(np.uint64)


def of_column(texts: pa.Array, k: int = K, size: int = SHINGLE) -> list[np.ndarray]:
    """Sketches of a column's texts; empty for null texts and texts without words."""
    out = []
    for group in _words.words_of(texts):
        inner = _words.windows(group.hashes, size)
        for a, b in zip(group.edges[:-1].tolist(), group.edges[1:].tolist(), strict=True):
            own = inner[a : b - size + 1] if b - a >= size else _words.shingles(group.hashes[a:b], size)
            out.append(bottom_k(own, k))
    return out


def sketch(df: DataFrame, text: str = "text", out: str = "fingerprint", k: int = K, size: int = SHINGLE) -> DataFrame:
    """Adds the sketch of each row's whole text, as text; a column of that name is replaced.

    Texts of fewer words than a shingle are one shingle; texts without words
    and null texts have the empty sketch "".
    """
    kept = [c for c in df.columns if c != out]
    schema = T.StructType([*df.select(*kept).schema.fields, T.StructField(out, T.StringType())])
    source = df.select(*kept) if text in kept else df.select(*kept, text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = pa.array([to_text(s) for s in of_column(b.column(text), k, size)], pa.string())
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], made], names=[*kept, out])

    return source.mapInArrow(lean(work), schema)


def merge_groups(df: DataFrame, keys: list[str], fingerprint: str = "fingerprint", k: int = K) -> DataFrame:
    """One sketch for the parts of each group: (keys, fingerprint, distinct shingles estimated).

    Sketches are merged within each task first and then by key, so a hot group
    sends a sketch from each task, not its rows.
    """
    schema = T.StructType([*df.select(*keys).schema.fields, T.StructField(fingerprint, T.StringType())])
    final = T.StructType([*schema.fields, T.StructField("distinct_shingles", T.DoubleType())])

    def combined(batches: Iterator[pa.RecordBatch]) -> dict[tuple, np.ndarray]:
        held: dict[tuple, np.ndarray] = {}
        for b in batches:
            for *key, s in zip(*[b.column(c).to_pylist() for c in [*keys, fingerprint]], strict=True):
                now = from_text(s or "")
                held[tuple(key)] = merge([held[tuple(key)], now], k) if tuple(key) in held else now
        return held

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        for b in batches:
            for key, s in combined(iter([b])).items():
                held[key] = merge([held[key], s], k) if key in held else s
            if len(held) > 50_000:
                yield packed(held, False)
                held = {}
        yield packed(held, False)

    def packed(held: dict[tuple, np.ndarray], full: bool) -> pa.RecordBatch:
        rows = [dict(zip(keys, key, strict=True)) | {fingerprint: to_text(s)} | ({"distinct_shingles": distinct_count(s, k)} if full else {}) for key, s in held.items()]
        return pa.RecordBatch.from_pylist(rows, schema=to_arrow_schema(final if full else schema))

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield packed(combined(batches), True)

    return df.select(*keys, fingerprint).mapInArrow(lean(partial), schema).repartition(*keys).mapInArrow(lean(total), final)


def with_next(df: DataFrame, key: str, text: str, work, schema: T.StructType) -> DataFrame:
    """Runs ``work`` over rows together with the text that follows in descending order of the key.

    ``work`` gets an iterator of (keys, texts, next texts) lists. The keys are
    cut into ranges; the first row of each range goes to the range above it as
    well, so one shuffle brings each row and its follower together. Rows with a
    null key come last, rows of one key in ascending order of their texts; the
    last row is followed by the first.
    """
    spark = df.sparkSession
    rows = df.select(F.col(key).alias("__k"), F.coalesce(F.col(text), F.lit("")).alias("__t"))
    bytes_ = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    parts = min(MOST_RANGES, max(2, 2 * shuffle_width(spark), -(-bytes_ // RANGE_BYTES)))
    cuts = sorted(set(df.select(F.col(key).cast("double").alias("k")).approxQuantile("k", [i / parts for i in range(1, parts)], 1 / (8 * parts))))
    # The greatest keys have the first range. A row is told the stretch of cuts that it falls into first, then the cut there.
    coarse = max(1, int(len(cuts) ** 0.5))
    stretches = [cuts[i : i + coarse] for i in range(0, len(cuts), coarse)]
    number = F.lit(0)
    if cuts:
        at = F.col("__k").cast("double")
        below = F.size(F.filter(F.array(*[F.lit(c[0]) for c in stretches]), lambda c: c <= at))
        inner = F.size(F.filter(F.element_at(F.array(*[F.array(*map(F.lit, c)) for c in stretches]), F.greatest(below, F.lit(1))), lambda c: c <= at))
        number = F.lit(len(cuts)) - F.when(below == 0, F.lit(0)).otherwise((below - 1) * coarse + inner)
    rows = rows.withColumn("__r", F.when(F.col("__k").isNull(), F.lit(len(cuts) + 1)).otherwise(number).cast("int"))
    # A range begins with its greatest key; where that repeats, the reader takes the first of its rows.
    heads = sorted(rows.select("__r", "__k").groupBy("__r").agg(F.max("__k").alias("__k")).collect(), key=lambda h: h["__r"])
    if not heads:
        return spark.createDataFrame([], schema)
    guest_of = {h["__r"]: heads[i - 1]["__r"] for i, h in enumerate(heads)}
    def table(pairs: dict) -> F.Column:
        return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])

    named = {h["__r"]: h["__k"] for h in heads if h["__k"] is not None}
    is_head = F.col("__k").isNull()
    if named:
        is_head = is_head | F.coalesce(table(named)[F.col("__r")] == F.col("__k"), F.lit(False))
    to = table(guest_of)[F.col("__r")]
    own = F.struct(F.col("__r").alias("r"), F.lit(False).alias("guest"))
    guest = F.struct(to.alias("r"), F.lit(True).alias("guest"))
    dealt = rows.withColumn("__at", F.explode(F.when(is_head, F.array(own, guest)).otherwise(F.array(own))))
    dealt = dealt.select(F.col("__at.r").alias("__r"), F.col("__at.guest").alias("__g"), "__k", "__t")
    ordered = dealt.repartitionById(len(cuts) + 2, F.col("__r")).sortWithinPartitions(
        "__r", "__g", F.col("__k").desc_nulls_last(), F.col("__t")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        at, closed = None, False
        for b in batches:
            for j in range(0, b.num_rows, 256):
                c = b.slice(j, 256)
                keys, texts, nexts = [], [], []
                for r, g, k, t in zip(*[c.column(n).to_pylist() for n in ("__r", "__g", "__k", "__t")], strict=True):
                    if r != at:
                        at, closed, held = r, False, None
                    if closed:
                        continue
                    if held is not None:
                        keys.append(held[0])
                        texts.append(held[1])
                        nexts.append(t)
                    held, closed = (k, t), g
                if keys:
                    yield work(keys, texts, nexts)

    return ordered.mapInArrow(lean(run), schema)


def edited(text: str, following: str) -> str:
    """The text with its last third replaced by the first as many code points of the one that follows."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def compare_edits(df: DataFrame, key: str = "doc_id", text: str = "text", k: int = K, size: int = SHINGLE) -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likeness.

    (key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next). Null and empty texts have the empty fingerprint "" and are alike with one
    another; a single row follows itself. Very long texts are read whole. Rows that
    repeat a key are rows of their own, and those that tie are put in the
    order of their texts; rows with a null key come last. Other columns aren't read, whatever their names. An empty table stays empty.
    """
    schema = T.StructType(
        [
            T.StructField(key, df.schema[key].dataType),
            T.StructField("n_chars", T.LongType()),
            *[T.StructField(n, T.StringType()) for n in ("edited_sha256", "fingerprint", "edited_fingerprint")],
            *[T.StructField(n, T.DoubleType()) for n in ("near_edited", "near_next")],
        ]
    )

    def work(keys: list, texts: list[str], nexts: list[str]) -> pa.RecordBatch:
        changed = [edited(t, n) for t, n in zip(texts, nexts, strict=True)]
        own = of_column(pa.array([*texts, nexts[-1]], pa.large_string()), k, size)
        # Within a run the next text is the next row's; where a range ends it isn't.
        follow = own[1:]
        for i in range(len(texts) - 1):
            if nexts[i] is not texts[i + 1] and nexts[i] != texts[i + 1]:
                follow[i] = of_column(pa.array([nexts[i]], pa.large_string()), k, size)[0]
        other = of_column(pa.array(changed, pa.large_string()), k, size)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(keys, to_arrow_type(df_key)),
                pa.array([len(t) for t in texts], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()),
                pa.array([to_text(s) for s in own[:-1]], pa.string()),
                pa.array([to_text(s) for s in other], pa.string()),
                pa.array([resemblance(a, b, k) for a, b in zip(own, other, strict=False)], pa.float64()),
                pa.array([resemblance(a, b, k) for a, b in zip(own, follow, strict=False)], pa.float64()),
            ],
            names=schema.names,
        )

    df_key = df.schema[key].dataType
    return with_next(df, key, text, work, schema)

