"""Quality classifier: naive Bayes support vectors over word n-gram indicators.

Features are hashed indicators of a text's words, word pairs, word endings of
two and three bytes, and of how often a word follows itself. Each indicator is
scaled by its class log-count ratio, rows are brought to length one, and a
linear hinge-loss model is fitted by dual coordinate descent. A sigmoid fitted
on rows that the descent didn't see turns margins into scores.

The model is fitted on a bounded sample of labelled rows, ``Settings.rows``;
every text is scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taskloom.llm import _words
from taskloom.llm._memory import lean, release

_BITS = 18
SIZE = 1 << _BITS
#: The feature that every text has, and the first of the features of words that follow themselves.
_ALWAYS, _RUN = 0, 1
_RUNS = (1, 2, 4, 8)


@dataclass(frozen=True)
class Settings:
    #: Labelled rows that the model is fitted on at most.
    rows: int = 8000
    #: Features of a row that the fit looks at, at most; of a row with more, those with the least hashes. Scores look at all.
    row_features: int = 8192
    smoothing: float = 1.0
    cost: float = 1.0
    epochs: int = 20
    #: Weight of the fitted model against its mean weight.
    own: float = 0.75
    #: Scores from here on count as class 1.
    threshold: float = 0.3


@dataclass
class Model:
    """Weight and squared scale of each feature, and the sigmoid."""

    weight: np.ndarray
    square: np.ndarray
    slope: float
    offset: float

    def margin(self, features: np.ndarray) -> float:
        return float(self.weight[features].sum() / np.sqrt(self.square[features].sum() + 1e-12))

    def score(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.offset, -500, 500)))


def features(texts: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct features of each text; for texts without words, only the one all have."""

    def place(x: np.ndarray) -> np.ndarray:
        return (16 + _words.mix(x) % np.uint64(SIZE - 16)).astype(np.int32)

    for group in _words.words_of(texts, lower=False, tails=True):
        h, tails = group.hashes, group.tails.astype(np.uint64)
        word, pair = place(h), place(_words.windows(h, 2))
        # The last byte is the highest of the 24 bits.
        ending = place(tails + np.uint64(1 << 40))
        short = place((tails >> np.uint64(8)) + np.uint64(1 << 41))
        same = np.concatenate(([False], h[1:] == h[:-1])) if len(h) else np.zeros(0, bool)
        same[group.edges[:-1][group.edges[:-1] < len(h)]] = False
        for a, b in zip(group.edges[:-1].tolist(), group.edges[1:].tolist(), strict=True):
            repeats = int(same[a:b].sum())
            runs = [_RUN + i for i, n in enumerate(_RUNS) if repeats >= n * max(1, (b - a) // 256)]
            yield np.unique(np.concatenate((np.array([_ALWAYS, *runs], np.int32), word[a:b], pair[a : max(a, b - 1)], ending[a:b], short[a:b])))


def _least(found: np.ndarray, most: int) -> np.ndarray:
    if len(found) <= most:
        return found
    hashes = _words.mix(found.astype(np.uint64) + np.uint64(1))
    return np.sort(found[np.argpartition(hashes, most)[:most]])


def _ratios(rows: list[np.ndarray], labels: np.ndarray, smoothing: float) -> np.ndarray:
    """Class log-count ratio of each feature; 0 for features that no row has."""
    counts = []
    for label in (1, 0):
        own = [r for r, y in zip(rows, labels, strict=True) if y == label]
        counts.append(np.bincount(np.concatenate(own), minlength=SIZE).astype(float) if own else np.zeros(SIZE))
    seen = (counts[0] + counts[1]) > 0
    p, q = (np.where(seen, c + smoothing, 0) for c in counts)
    out = np.zeros(SIZE)
    np.log(np.divide(p / max(p.sum(), 1e-12), q / max(q.sum(), 1e-12), out=np.ones(SIZE), where=seen), out=out)
    out[_ALWAYS] = 1.0
    return out


def _descend(rows: list[np.ndarray], values: list[np.ndarray], labels: np.ndarray, settings: Settings) -> np.ndarray:
    """Dual coordinate descent for the hinge loss, classes weighted by their inverse shares."""
    w, alpha = np.zeros(SIZE), np.zeros(len(rows))
    sign = np.where(labels == 1, 1.0, -1.0)
    share = np.array([max(1, (labels == c).sum()) for c in (0, 1)]) / max(1, len(labels))
    cost = settings.cost * 0.5 / share[labels]
    square = np.array([float(v @ v) for v in values])
    rng = np.random.Generator(np.random.PCG64(11))
    for _ in range(settings.epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)).tolist():
            gradient = sign[i] * float(w[rows[i]] @ values[i]) - 1
            to = min(max(alpha[i] - gradient / max(square[i], 1e-12), 0.0), cost[i])
            if to != alpha[i]:
                w[rows[i]] += (to - alpha[i]) * sign[i] * values[i]
                moved = max(moved, abs(to - alpha[i]))
                alpha[i] = to
        if moved < 1e-3:
            break
    return w


def _sigmoid(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset that fit labels best, with targets drawn in for few rows; by Newton steps."""
    n1, n0 = int((labels == 1).sum()), int((labels == 0).sum())
    goal = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -500, 500)))
        d, v = p - goal, np.maximum(p * (1 - p), 1e-9)
        g = np.array([(d * margins).sum() + 1e-3 * a, d.sum()])
        h = np.array([[(v * margins**2).sum() + 1e-3, (v * margins).sum()], [(v * margins).sum(), v.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 5 / max(1e-9, float(np.abs(step).max())))
        a, b = max(a - step[0], 1e-3), b - step[1]
        if np.abs(step).max() < 1e-7:
            break
    return float(a), float(b)


def fit(rows: list[np.ndarray], labels: np.ndarray, settings: Settings) -> Model:
    """A model of rows' features; with one class or none, all scores are that class's share."""
    if len(rows) < 8 or len(set(labels.tolist())) < 2:
        share = (float((labels == 1).sum()) + 1) / (len(labels) + 2)
        return Model(np.zeros(SIZE), np.zeros(SIZE), 0.0, float(np.log(share / (1 - share))))

    def trained(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ratio = _ratios([rows[i] for i in at], labels[at], settings.smoothing)
        length = [np.sqrt((ratio[rows[i]] ** 2).sum() + 1e-12) for i in at]
        values = [ratio[rows[i]] / n for i, n in zip(at, length, strict=True)]
        w = _descend([rows[i] for i in at], values, labels[at], settings)
        live = w != 0
        mean = np.abs(w[live]).mean() if live.any() else 0.0
        # Half of the way towards the plain ratios, as far as the mean weight goes.
        return (settings.own * w + (1 - settings.own) * mean * live) * ratio, ratio**2

    # The sigmoid learns from margins of rows outside the fit, a fourth at a time.
    margins = np.zeros(len(rows))
    for k in range(4):
        out = np.arange(len(rows)) % 4 == k
        if len(set(labels[~out].tolist())) < 2:
            continue
        weight, square = trained(np.flatnonzero(~out))
        part = Model(weight, square, 1, 0)
        margins[out] = [part.margin(rows[i]) for i in np.flatnonzero(out)]
    slope, offset = _sigmoid(margins, labels)
    return Model(*trained(np.arange(len(rows))), slope, offset)


def train(df: DataFrame, labelled: DataFrame, label: str, settings: Settings, key: str = "doc_id", text: str = "text") -> Model:
    """Fits a model on at most ``settings.rows`` rows of ``labelled`` (key, label of 0 or 1), the first by a hash of the key."""
    sample = labelled.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).select(key, F.col(label).cast("int").alias("__y"))
    sample = sample.orderBy(F.xxhash64(key), key, "__y").limit(settings.rows)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [_least(f, settings.row_features).tobytes() for f in features(b.column("t"))]
            yield pa.RecordBatch.from_arrays([b.column("h"), b.column("y"), pa.array(made, pa.binary())], names=["h", "y", "f"])

    # The sample's bound makes it fit for a broadcast, whatever the tables' sizes.
    rows = df.select(key, text).join(F.broadcast(sample), key).select(F.xxhash64(key).alias("h"), F.col("__y").alias("y"), F.col(text).alias("t"))
    # A key that repeats among the documents counts once, so no more rows come back than were sampled.
    made = rows.mapInArrow(lean(work), "h long, y int, f binary").groupBy("h", "y").agg(F.min("f").alias("f"))
    found = made.toArrow().sort_by([("h", "ascending"), ("y", "ascending")]).slice(0, settings.rows)
    model = fit([np.frombuffer(f, np.int32) for f in found.column("f").to_pylist()], found.column("y").to_numpy().astype(np.int64), settings)
    del found
    # The fit's memory goes back to the system: the driver has little.
    release()
    return model


def score(df: DataFrame, model: Model, out: str = "score", text: str = "text") -> DataFrame:
    """Adds each whole text's score, from 0 to 1; higher means that class 1 is likelier.

    Null and empty texts get the score of a text without words. A column
    named ``out`` is replaced; an empty table stays empty.
    """
    kept = [c for c in df.columns if c != out]
    schema = T.StructType([*df.select(*kept).schema.fields, T.StructField(out, T.DoubleType())])
    source = df.select(*kept) if text in kept else df.select(*kept, text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            margins = np.array([model.margin(f) for f in features(b.column(text))])
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], pa.array(model.score(margins), pa.float64())], names=[*kept, out])

    return source.mapInArrow(lean(work), schema)


def classify(
    df: DataFrame, labelled: DataFrame, learn: Column, label: str = "quality", settings: Settings | None = None, key: str = "doc_id", text: str = "text", names: tuple[str, str] = ("score", "predicted")
) -> DataFrame:
    """Adds ``score`` and ``predicted`` (1 from the threshold on), or what ``names`` calls them, learning from the labelled rows where ``learn`` holds.

    Null and empty texts get the score of a text without words; very long ones are
    scored whole. Rows that repeat or tie have equal scores; a key that repeats, among documents or labels, is learned once
    for each label. Null keys aren't learned from. Columns named as an added one are replaced, all others kept. An empty
    table stays empty; without labels of both classes all scores are alike.
    """
    settings = settings or Settings()
    model = train(df, labelled.where(learn), label, settings, key, text)
    scored = score(df.drop(names[1]), model, names[0], text)
    return scored.withColumn(names[1], (F.col(names[0]) >= settings.threshold).cast("int"))
