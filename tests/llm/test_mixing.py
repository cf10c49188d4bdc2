import numpy as np
import pytest
from pyspark.sql import functions as F

from taskloom.llm import mixing, queries
from tests.llm import corpus

MIX = mixing.Mixture({"source": {"hot": 0.3, "*": 0.7}, "lang": {"en": 0.5, "de": 0.2, "*": 0.3}}, keep=0.5)


def tokens():
    return mixing.word_count(F.col("text"))


def fitted(counts, cells, targets, keeps=(0.01,), sweeps=400):
    plans = mixing.goals(counts, cells, targets)
    return plans, *mixing.rake(counts, plans, np.array(keeps), sweeps)


def test_margins_are_met():
    rng = np.random.default_rng(3)
    cells = [(a, b) for a in "xyz" for b in "pq"]
    tokens = rng.integers(1, 1000, len(cells)).astype(float)
    targets = [{"x": 0.2, "y": 0.5, "z": 0.3}, {"p": 0.9, "q": 0.1}]
    _, (w,), (error,) = fitted(tokens, cells, targets, keeps=(1e-9,))
    assert error < 1e-12
    for k, goal in enumerate(targets):
        for name, share in goal.items():
            assert sum(x for x, c in zip(w, cells, strict=True) if c[k] == name) == pytest.approx(share)
    # Raking without a cap in the way keeps the cells' odds ratios.
    assert w[0] * w[3] / (w[1] * w[2]) == pytest.approx(tokens[0] * tokens[3] / (tokens[1] * tokens[2]))


def test_caps_hold_and_margins_too():
    """Plain raking would want more of the cell (x, p) than there is; the others of its margins make up for it."""
    cells, tokens = [("x", "p"), ("x", "q"), ("y", "p"), ("y", "q")], np.array([10.0, 190.0, 390.0, 410.0])
    targets = [{"x": 0.5, "y": 0.5}, {"p": 0.5, "q": 0.5}]
    plans, weights, errors = fitted(tokens, cells, targets, keeps=(0.38, 0.9))
    assert errors[0] < 1e-6 < errors[1]
    assert (weights <= tokens / tokens.sum() / np.array([[0.38], [0.9]]) + 1e-12).all()
    assert weights[0] @ [1, 1, 0, 0] == pytest.approx(0.5) and weights[0] @ [1, 0, 1, 0] == pytest.approx(0.5)


def test_keep_falls_to_what_the_targets_allow():
    rng = np.random.default_rng(2)
    cells = [("a",), ("b",)]
    drawn = rng.multinomial(100_000, np.full(512, 1 / 512), 2) * np.array([[1], [9]])
    found = mixing.fit_cells(drawn.astype(float), cells, mixing.Mixture({"s": {"a": 0.5, "b": 0.5}}, keep=0.6))
    assert 0.19 * 0.93 < found.keep <= 0.2 and found.residual < 0.005 and (found.chance <= 1).all()
    assert [m[:3] for m in found.margins] == [("s", "a", 0.5), ("s", "b", 0.5)]


def test_empty_categories_and_others():
    tokens, cells = np.array([5.0, 5.0]), [("a",), ("b",)]
    assert fitted(tokens, cells, [{"a": 0.5, "c": 0.5}])[1].tolist() == [[1, 0]]
    assert fitted(np.array([5.0]), [("b",)], [{"c": 1.0}])[1].tolist() == [[1]]
    # What the targets don't name keeps its share.
    assert fitted(np.array([2.0, 3.0, 5.0]), [("*",), ("a",), ("b",)], [{"a": 0.5, "b": 0.5}])[1][0] == pytest.approx([0.2, 0.4, 0.4])
    with pytest.raises(ValueError):
        mixing.Mixture({"a": {"x": -1}})


def test_sampled_shares_meet_the_targets(spark):
    rng = np.random.default_rng(5)
    data = [(i, " w" * int(rng.integers(1, 9)), "en" if rng.random() < 0.8 else "de", "hot" if rng.random() < 0.6 else "s", 1) for i in range(6000)]
    mix = mixing.Mixture({"source": {"hot": 0.3, "*": 0.7}, "lang": {"en": 0.7, "de": 0.3}}, keep=0.5)
    got = mixing.sample(corpus.frame(spark, data), mix, tokens()).select("source", "lang", tokens().alias("n")).collect()
    total = sum(r.n for r in got)
    assert total == pytest.approx(0.5 * sum(len(corpus.words(r[1])) for r in data), rel=0.02)
    assert sum(r.n for r in got if r.source == "hot") / total == pytest.approx(0.3, abs=0.005)
    assert sum(r.n for r in got if r.lang == "en") / total == pytest.approx(0.7, abs=0.005)


@pytest.mark.parametrize(("sf", "most"), [("sf0.01", 0.02), ("sf0.1", 0.005)])
def test_query_meets_the_targets(spark, sf, most):
    """The sampled rows of the query, by every margin; the residuals that the operator tells are theirs."""
    rows = queries.op1_mix_to_targets(spark, f"/root/testdata/{sf}").collect()
    total = sum(r.n_tokens for r in rows)
    told = queries.documents(spark, f"/root/testdata/{sf}").withColumn("n", tokens())
    margins = mixing.margins(told, queries.MIXTURE, F.col("n"), values={"topic": queries.topic(F.col("text"))}).collect()
    assert len(margins) == sum(len(t) for t in queries.MIXTURE.targets.values())
    for m in margins:
        named = queries.MIXTURE.targets[m.column]
        share = sum(r.n_tokens for r in rows if (r[m.column] if r[m.column] in named else "*") == m.category) / total
        assert share == pytest.approx(m.sampled) and abs(m.sampled - m.target) <= most and m.expected == pytest.approx(m.target, abs=1e-4)
        assert m.target == pytest.approx(named[m.category])


def test_nulls_repeats_names_and_empty_tables(spark):
    df = corpus.frame(spark, [*corpus.rows(), (None, None, None, None, None), (0, "twice", "en", "hot", 5)]).withColumn("mix_weight", F.lit("mine")).withColumn("topic", F.lit("own"))
    got = mixing.mix_weights(df, MIX, tokens())
    assert got.count() == df.count() and dict(got.dtypes)["mix_weight"] == "double" and got.where("mix_weight is null or mix_probability is null").count() == 0
    by_text = mixing.Mixture({"topic": {"prose": 0.5, "table": 0.5}})
    kept = mixing.sample(df, by_text, tokens(), values={"topic": queries.topic(F.col("text"))})
    assert {r.topic for r in kept.collect()} == {"own"}
    first = {r.doc_id for r in mixing.sample(df, MIX, tokens()).collect()}
    assert first == {r.doc_id for r in mixing.sample(df.repartition(5), MIX, tokens()).collect()}
    assert mixing.sample(df.limit(0), MIX, tokens()).count() == 0
    assert mixing.margins(df.limit(0), MIX, tokens()).count() == 0
    assert mixing.sample(df.where("text = ''"), MIX, tokens()).count() == 0
