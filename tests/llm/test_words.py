import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st

from taskloom.llm import _blobs, _words
from tests.llm import corpus


def hashes(texts, **options):
    return [g.of(i).tolist() for g in _words.words_of(pa.array(texts, pa.string()), **options) for i in range(len(g))]


@given(st.lists(st.one_of(st.none(), st.text("aAbB \t\n\x0b\x1fé€\x00,")), max_size=8))
def test_words_are_the_pattern_s(texts):
    found = hashes(texts)
    assert [len(h) for h in found] == [len(corpus.words(t)) for t in texts]
    seen = {}
    for t, h in zip(texts, found, strict=True):
        for w, x in zip(corpus.words(t, lower=True), h, strict=True):
            assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)


@pytest.mark.parametrize("size", [7, 64, 10_000])
def test_chunks_change_nothing(monkeypatch, size):
    texts = [r[1] for r in corpus.rows()]
    whole = hashes(texts, lower=False)
    monkeypatch.setattr(_words, "CHUNK_BYTES", size)
    assert hashes(texts, lower=False) == whole


def test_long_words_differ_by_their_ends():
    assert len({tuple(h) for h in hashes(["a" * n + e for n in range(1, 30) for e in "xy"])}) == 58


def test_slices_and_tails():
    column = pa.array(["skip me", "ab cdef", None, "ab"]).slice(1)
    group = next(_words.words_of(column, tails=True))
    assert group.edges.tolist() == [0, 2, 2, 3] and group.tails[0] == group.tails[2] != group.tails[1]


def test_shingles():
    h = np.arange(1, 7, dtype=np.uint64)
    assert len(_words.shingles(h, 4)) == 3 and len(_words.shingles(h[:2], 4)) == 1 and len(_words.shingles(h[:0], 4)) == 0
    assert _words.shingles(h[:2], 4)[0] != _words.shingles(h[:3], 4)[0]


def test_blobs():
    columns = [np.arange(5, dtype=np.uint16), np.array([], np.int64), np.array([1.5])]
    back = _blobs.unpack(_blobs.pack(*columns))
    assert all(a.dtype == b.dtype and (a == b).all() for a, b in zip(columns, back, strict=True))
    order, parts = _blobs.by_bucket(np.array([3, 1, 3, 1]))
    assert order.tolist() == [1, 3, 0, 2] and parts == [(1, 0, 2), (3, 2, 4)]
