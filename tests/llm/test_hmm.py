import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from taskloom.llm import _words, hmm
from taskloom.llm._store import Workspace
from tests.llm import corpus


def toy(states=3, seed=1):
    rng = np.random.default_rng(seed)
    emit = np.zeros((hmm.END + 1, states))
    live = [0, 1, 2, 3, hmm.END]
    emit[live] = rng.random((5, states)) + 0.1
    return hmm.Model(rng.dirichlet(np.ones(states)), rng.dirichlet(np.ones(states), states), emit / emit.sum(axis=0)), live


def paths(model, sequence):
    """The likelihood by the plain recursion, and by sums over all paths for short ones."""
    a = model.start * model.emit[sequence[0]]
    for c in sequence[1:]:
        a = (a @ model.move) * model.emit[c]
    return math.log(a.sum())


def test_forward_is_exact():
    model, live = toy()
    rng = np.random.default_rng(2)
    sequences = [rng.choice(live, n).astype(np.uint16) for n in (1, 2, 3, 40, 33, 32, 31, 7)]
    assert hmm.forward(model, sequences) == pytest.approx([paths(model, s) for s in sequences])
    long = rng.choice(live, 5000).astype(np.uint16)
    assert hmm.forward(model, [long, long[:1]])[0] == pytest.approx(hmm.forward(model, [long])[0])


def test_expected_counts_by_enumeration():
    import itertools

    model, live = toy(2)
    s = np.array([0, 2, 1, hmm.END], np.uint16)
    classes, moves, starts, loglik = hmm.expected_counts(model, [s, s[:1]])
    weight = {}
    for p in itertools.product(range(2), repeat=4):
        w = model.start[p[0]] * model.emit[s[0], p[0]]
        for t in range(1, 4):
            w *= model.move[p[t - 1], p[t]] * model.emit[s[t], p[t]]
        weight[p] = w
    total = sum(weight.values())
    want = np.zeros((2, 2))
    for p, w in weight.items():
        for t in range(1, 4):
            want[p[t - 1], p[t]] += w / total
    assert moves == pytest.approx(want, rel=1e-4)
    assert classes.sum() == pytest.approx(5, rel=1e-5) and starts.sum() == pytest.approx(2, rel=1e-5)
    assert loglik == pytest.approx(paths(model, s) + paths(model, s[:1]), rel=1e-5)


def test_nothing_underflows():
    """Words of any rareness, many in a row: scores stay finite and right, and so does training."""
    emit = np.full((hmm.END + 1, 2), 1e-30)
    emit[0] = 1e-11, 2e-11
    model = hmm.Model(np.full(2, 0.5), np.array([[0.9, 0.1], [0.2, 0.8]]), emit)
    assert hmm.forward(model, [np.ones(400, np.int64)]) == pytest.approx([400 * math.log(1e-30)])
    assert -1013 < hmm.forward(model, [np.zeros(40, np.int64)])[0] < -980
    classes, _, _, loglik = hmm.expected_counts(model, [np.ones(400, np.int64), np.zeros(7, np.int64)])
    assert np.isfinite(loglik) and classes[1].sum() == pytest.approx(400, rel=1e-4) and classes[0].sum() == pytest.approx(7, rel=1e-4)


def test_very_long_texts_count_whole(monkeypatch):
    """Piece by piece, the expected counts are those of the text in one."""
    model, live = toy()
    rng = np.random.default_rng(5)
    sequences = [rng.choice(live, n) for n in (60, 333, 5, 128)]
    whole = hmm.expected_counts(model, sequences)
    monkeypatch.setattr(hmm, "LONG", 50)
    monkeypatch.setattr(hmm, "PIECE", 32)
    for got, want in zip(hmm.expected_counts(model, sequences), whole, strict=True):
        assert got == pytest.approx(want, rel=1e-4)


def tongues(n=300):
    rng = np.random.default_rng(4)
    words = [[f"{c}{i}" for i in range(60)] for c in "xyz"]
    return [(i, " ".join(rng.choice(words[i % 3], 30)), None, "s", 1) for i in range(n)]


def rows_of(df, held):
    return df.select(F.col("doc_id").alias("k"), F.col("text").alias("t"), held.alias("held"))


def test_training_climbs_and_stops(spark):
    df = corpus.frame(spark, tongues())
    fitted = hmm.fit(rows_of(df, F.lit(False)), hmm.Settings(states=3, rounds=60, gain=1e-3, prior=1e-6), Workspace(spark, "t"))
    path = fitted.path
    assert 3 < len(path) < 60 and all(b >= a - 1e-2 for a, b in zip(path, path[1:], strict=False)) and path[-1] > path[0] + 1000
    assert len(hmm.fit(rows_of(df, F.lit(False)), hmm.Settings(states=3, rounds=2), Workspace(spark, "t")).path) == 2


def by_word(fitted):
    """Emissions of each word, and of one never seen in each class, as told by the table of words; by hash."""
    table, out = fitted.emissions.table(), {}
    for h, i in zip(fitted.frequent.hashes.tolist(), range(len(fitted.frequent.hashes)), strict=True):
        out[h] = table[i]
    for r in fitted.words.collect():
        h = r.h % 2**64
        if r.v is not None:
            sums = np.frombuffer(r.v, np.float32)[None].astype(float)
            out[h] = fitted.emissions.of_words(np.array([r.kind]), np.array([r.c]), sums)[0]
        else:
            out[h] = table[hmm.FREQUENT + r.kind] * (r.c + 1)
    return out, table


@pytest.mark.parametrize("frequent", [64_000, 20])
def test_scores(spark, frequent):
    """Every column against brute force; with few frequent words, nearly all have their emissions from the table of words."""
    data = tongues()
    data += [(300, None, None, None, None), (301, "", None, None, None), (302, "Never seen WORDS", None, None, None), (303, "x1 X1 " * 3000, None, None, None), (None, "x1", None, None, None), (5, data[5][1], None, None, None)]
    data += [(304 + i, f"x2 seldom{i} rare{i % 4} y3", None, None, None) for i in range(12)]
    df = corpus.frame(spark, data)
    held, settings = F.coalesce(F.col("doc_id") % 7 == 2, F.lit(False)), hmm.Settings(states=4, rounds=8, frequent=frequent)
    got = hmm.score_texts(df, held, settings).collect()
    assert len(got) == len(data)
    tokens = {i: [*corpus.words(t, lower=True), 0] for i, t, *_ in data}
    counts = Counter(w for i, t, *_ in data if i is None or i % 7 != 2 for w in [*corpus.words(t, lower=True), 0])
    n, v = sum(counts.values()), len(counts)
    fitted = hmm.fit(rows_of(df, held), settings, Workspace(spark, "t"))
    emissions, table = by_word(fitted)
    # All words, those never seen of each class and the end have probability one together.
    together = sum(emissions.values()) + table[hmm.FREQUENT : hmm.END].sum(axis=0) + table[hmm.END]
    unused = table[len(fitted.frequent.counts) : hmm.FREQUENT].sum(axis=0)
    assert together + unused == pytest.approx(np.ones(4), rel=1e-5)
    assert frequent > 20 or sum(r.v is not None for r in fitted.words.collect()) > 100
    hashes = {w: next(_words.words_of(pa.array([w]), tails=True)) for w in set().union(*tokens.values()) - {0}}
    model = fitted.emissions.model
    for r in got:
        t = tokens[r.doc_id]
        assert r.n_tokens == len(t) and r.n_known == sum(counts[w] > 0 for w in t) and r.train_tokens == n
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in t), rel=1e-9)
        assert r.held_out == (r.doc_id is not None and r.doc_id % 7 == 2)
        state, total = None, 0.0
        for w in t:
            if w == 0:
                e = table[hmm.END]
            else:
                e = emissions.get(int(hashes[w].hashes[0]))
                e = table[hmm.FREQUENT + hmm.rare_class(hashes[w].tails)[0]] if e is None else e
            state = (model.start if state is None else state @ model.move) * e
            total += math.log10(state.sum())
            state = state / state.sum()
        assert r.score == pytest.approx(total, rel=1e-5)
    out = [r for r in got if r.held_out and r.doc_id < 300]
    assert sum(r.score for r in out) > sum(r.base_score for r in out) + 5 * len(out)
    assert hmm.score_texts(df.limit(0), held).count() == 0
    assert all(r.n_known == 0 and np.isfinite(r.score) for r in hmm.score_texts(df.limit(5), F.lit(True)).collect())


def test_words_that_many_chunks_ask_for(spark, monkeypatch):
    """They go to several tasks, and the scores are the same."""
    df = corpus.frame(spark, tongues(60))
    settings = hmm.Settings(states=2, rounds=2, frequent=5)
    want = {r.doc_id: r.score for r in hmm.score_texts(df, F.lit(False), settings).collect()}
    monkeypatch.setattr(hmm, "TASK_WORDS", 2)
    got = {r.doc_id: r.score for r in hmm.score_texts(df, F.lit(False), settings).collect()}
    assert got == pytest.approx(want, rel=1e-6)


def test_probabilities_sum_to_one(spark):
    """A class's mass is what its words and, if it is a rare one, a word never seen take of it together."""
    words = [(5, 0, 9), (6, 1, 7), (7, 1, 2), (8, 3, 1), (int(hmm._END_HASH), hmm.RARE, 4)]
    counts = spark.createDataFrame(words, "h long, kind long, c long")
    frequent = hmm.Frequent(np.array([6, 5], np.uint64), np.array([7, 9]), np.array([1, 0]))
    mass = hmm._class_mass(counts, frequent)
    at, hit = frequent.find(np.array([6, 9], np.uint64))
    assert hit.tolist() == [True, False] and frequent.counts[at[0]] == 7
    assert mass[:2].tolist() == [10, 8] and mass[hmm.END] == 5
    rare = {k: 1 for k in range(hmm.RARE)}
    for _, kind, c in words[2:4]:
        rare[kind] += c + 1
    assert mass[hmm.FREQUENT : hmm.END].tolist() == [rare[k] for k in range(hmm.RARE)]
