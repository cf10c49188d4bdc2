import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from taskloom.llm import quality
from tests.llm import corpus


def made(n, seed=0):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        w = [f"w{rng.randrange(800)}" for _ in range(rng.randrange(5, 60))]
        bad = i % 4 == 0
        if bad:
            w = [x.upper() + "!!" for x in w] if i % 8 else [x for x in w for _ in range(5)]
        rows.append((i, " ".join(w), "en", "s", 1))
        labels.append((i, 0 if bad else 1))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = made(900)
    df, marks = corpus.frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.classify(df, marks, F.col("doc_id") % 5 != 0).collect()}
    held = [(i, y) for i, y in labels if i % 5 == 0]
    assert sum(got[i].predicted == y for i, y in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_labels_outside_the_fold_change_nothing(spark):
    rows, labels = made(200)
    flipped = [(i, 1 - y if i % 5 == 0 else y) for i, y in labels]
    df = corpus.frame(spark, rows)
    a, b = (quality.classify(df, spark.createDataFrame(x, "doc_id long, quality int"), F.col("doc_id") % 5 != 0).collect() for x in (labels, flipped))
    assert sorted((r.doc_id, r.score) for r in a) == sorted((r.doc_id, r.score) for r in b)


def test_odd_rows_and_labels(spark):
    df = corpus.frame(spark, [*corpus.rows(), (None, "x", None, None, None)]).withColumnRenamed("n_chars", "score")
    some = spark.createDataFrame([(0, 1), (0, 1), (1, None), (None, 0), (99999, 0)], "doc_id long, quality int")
    for marks in (some, some.limit(0)):
        got = quality.classify(df, marks, F.lit(True)).collect()
        assert len(got) == df.count() and all(0 <= r.score <= 1 for r in got)
    assert quality.classify(df.limit(0), some, F.lit(True)).count() == 0


def test_descent_meets_its_conditions():
    rng = np.random.default_rng(1)
    rows = [np.unique(rng.integers(0, 50, 10)).astype(np.int32) for _ in range(120)]
    labels = np.array([int(5 in r or 7 in r) for r in rows])
    values = [np.ones(len(r)) / np.sqrt(len(r)) for r in rows]
    w = quality._descend(rows, values, labels, quality.Settings(epochs=500))
    margins = np.array([w[r] @ v for r, v in zip(rows, values, strict=True)]) * np.where(labels == 1, 1, -1)
    assert (margins > 0).mean() > 0.95


def test_features_are_distinct():
    found = list(quality.features(pa.array(["a b a b", None, "a a a a"])))
    assert all(len(set(f.tolist())) == len(f) for f in found) and found[1].tolist() == [0]
    assert {1, 2} <= set(found[2].tolist()) and 1 not in found[0].tolist()


def test_query_against_brute_force(spark):
    """Sample, features, ratios, margins and scores one by one, for every document of a table with odd rows."""
    rows, labels = made(160)
    rows += [(500, None, None, None, None), (501, "", None, None, None), (None, "w1 w2", None, None, None), (3, "another w5", None, None, None)]
    labels += [(500, 0), (None, 1), (3, 1)]
    settings = quality.Settings(rows=70)
    df, marks = corpus.frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int")
    learn = F.col("doc_id") % 5 != 0
    got = {(r.doc_id, r.text): (r.score, r.predicted) for r in quality.classify(df, marks, learn, settings=settings).collect()}
    order = {r.k: r.h for r in spark.createDataFrame([(i,) for i, *_ in rows if i is not None], "k long").select("k", F.xxhash64("k").alias("h")).distinct().collect()}
    sample = sorted({(order[i], i, y) for i, y in labels if i is not None and i % 5})[:70]

    def own(text):
        return next(iter(quality.features(pa.array([text], pa.string()))))

    fit_on = []
    for h, i, y in sample:
        fit_on.append((h, y, min((own(t) for k, t, *_ in rows if k == i), key=lambda f: f.tobytes())))
    fit_on.sort(key=lambda r: r[:2])
    model = quality.fit([f for *_, f in fit_on], np.array([y for _, y, _ in fit_on]), settings)
    ratio = {}
    for f in range(quality.SIZE):
        if model.square[f]:
            ratio[f] = model.weight[f], model.square[f]
    for i, t, *_ in rows:
        num = sum(ratio.get(f, (0, 0))[0] for f in own(t).tolist())
        den = sum(ratio.get(f, (0, 0))[1] for f in own(t).tolist())
        score = 1 / (1 + np.exp(-(model.slope * num / np.sqrt(den + 1e-12) + model.offset)))
        assert got[i, t][0] == np.float64(score).item() or abs(got[i, t][0] - score) < 1e-9
        assert got[i, t][1] == int(got[i, t][0] >= 0.3)
    # Ratios by plain counts.
    counts = {y: {} for y in (0, 1)}
    for _, y, f in fit_on:
        for x in f.tolist():
            counts[y][x] = counts[y].get(x, 0) + 1
    seen = set(counts[0]) | set(counts[1])
    total = [sum(counts[y].get(x, 0) + 1 for x in seen) for y in (0, 1)]
    for x in list(seen)[:200]:
        if x:
            want = np.log((counts[1].get(x, 0) + 1) / total[1]) - np.log((counts[0].get(x, 0) + 1) / total[0])
            assert abs(np.sqrt(model.square[x]) - abs(want)) < 1e-9


def test_rows_of_many_features_are_sampled_by_hash():
    found = np.arange(20_000, dtype=np.int32)
    some = quality._least(found, 500)
    assert len(some) == 500 and some.max() > 15_000 and some.min() < 5000 and (np.diff(some) > 0).all()
