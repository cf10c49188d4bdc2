import hashlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from taskloom.llm import _words, sketches
from tests.llm import corpus


@settings(max_examples=60)
@given(st.sets(st.integers(0, 400), max_size=300), st.sets(st.integers(0, 400), max_size=300))
def test_small_sets_are_exact(a, b):
    x, y = (np.sort(np.array(sorted(s), np.uint64)) for s in (a, b))
    got = sketches.resemblance(x, y, 1000)
    assert got == pytest.approx(len(a & b) / len(a | b) if a and b else float(not a and not b))
    assert sketches.distinct_count(x, 1000) == len(a)
    assert sketches.containment(x, y, 1000) == pytest.approx(len(a & b) / len(a) if a else 1.0)


def test_merged_parts_are_the_whole():
    rng = np.random.default_rng(1)
    whole = rng.integers(0, 2**64, 5000, np.uint64)
    parts = [sketches.bottom_k(p) for p in np.array_split(whole, 7)]
    assert (sketches.merge(parts) == sketches.bottom_k(whole)).all()
    assert sketches.distinct_count(sketches.bottom_k(whole)) == pytest.approx(5000, rel=0.3)
    assert (sketches.from_text(sketches.to_text(parts[0])) == parts[0]).all()
    assert len(sketches.bottom_k(np.repeat(whole[:50], 100))) == 50


def slow_print(text):
    """The least 128 hashes of a text's shingles, by one text and one shingle at a time."""
    words = corpus.words(text, True)
    runs = [words[i : i + 5] for i in range(len(words) - 4)] if len(words) >= 5 else [words] if words else []
    found = set()
    for run in runs:
        hashes = next(_words.words_of(pa.array([" ".join(run)]))).hashes
        found.add(int(_words.shingles(hashes, 5)[0]))
    return sorted(found)[:128]


def slow_likeness(a, b):
    """The share of the least hashes of both that both have."""
    if not a or not b:
        return float(not a and not b)
    least = sorted({*a, *b})[:128]
    return sum(x in a and x in b for x in least) / len(least)


@pytest.mark.parametrize("width", [1, 4, 40])
def test_edits_against_brute_force(spark, width):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", width)
    try:
        data = [r for r in corpus.rows(6)] + [(None, "last of all words", None, None, None)]
        got = {r.doc_id: r for r in sketches.compare_edits(corpus.frame(spark, data)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    order = sorted((r for r in data if r[0] is not None), key=lambda r: -r[0]) + [data[-1]]
    assert len(got) == len(data)
    for i, r in enumerate(order):
        text, following = r[1] or "", order[(i + 1) % len(order)][1] or ""
        edit = text[: len(text) - len(text) // 3] + following[: len(text) // 3]
        assert got[r[0]].n_chars == len(text) and got[r[0]].edited_sha256 == hashlib.sha256(edit.encode()).hexdigest()
        prints = [slow_print(x) for x in (text, edit, following)]
        assert [sketches.from_text(x).tolist() for x in (got[r[0]].fingerprint, got[r[0]].edited_fingerprint)] == prints[:2]
        assert got[r[0]].near_edited == pytest.approx(slow_likeness(prints[0], prints[1])) and got[r[0]].near_next == pytest.approx(slow_likeness(prints[0], prints[2]))
        a, b = ({tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set() for w in (corpus.words(text, True), corpus.words(following, True)))
        if len(a | b) <= 128:
            assert got[r[0]].near_next == pytest.approx(len(a & b) / len(a | b) if a and b else float(not a and not b))


def test_ranges_of_many_keys(spark, monkeypatch):
    """More ranges than shuffle partitions, null keys and keys that repeat: every row has its follower."""
    monkeypatch.setattr(sketches, "RANGE_BYTES", 200)
    rng = np.random.default_rng(3)
    data = [(int(k), f"t{int(k)} {i} x", None, None, 1) for i, k in enumerate(rng.integers(-300, 300, 700))] + [(None, f"none {i}", None, None, 1) for i in range(3)]
    got = {r.edited_sha256 for r in sketches.compare_edits(corpus.frame(spark, data)).collect()}
    order = sorted((r for r in data if r[0] is not None), key=lambda r: (-r[0], r[1])) + sorted((r for r in data if r[0] is None), key=lambda r: r[1])
    want = {hashlib.sha256(sketches.edited(r[1], order[(i + 1) % len(order)][1]).encode()).hexdigest() for i, r in enumerate(order)}
    assert got == want


def test_equal_texts_have_equal_prints(spark):
    df = corpus.frame(spark).withColumn("fingerprint", F.lit(3))
    got = sketches.sketch(df).collect()
    by = {}
    for r in got:
        assert by.setdefault(" ".join(corpus.words(r.text, True)), r.fingerprint) == r.fingerprint
    assert len(got) == df.count() and by[""] == ""
    assert sketches.sketch(df.limit(0)).count() == 0
    assert sketches.compare_edits(df.limit(0)).count() == 0
    one = sketches.compare_edits(corpus.frame(spark, [(1, "abcdef", None, None, 6)])).first()
    assert one.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest()


def test_groups_merge(spark):
    df = sketches.sketch(corpus.frame(spark))
    got = {r.source: r for r in sketches.merge_groups(df, ["source"]).collect()}
    want = {}
    for r in df.collect():
        want.setdefault(r.source, []).append(sketches.from_text(r.fingerprint))
    assert {k: r.fingerprint for k, r in got.items()} == {k: sketches.to_text(sketches.merge(v)) for k, v in want.items()}
