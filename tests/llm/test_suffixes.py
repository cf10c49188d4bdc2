import hashlib
import itertools
import os

import numpy as np
import pyarrow as pa
import pytest

from taskloom.llm import _blobs, _words, suffixes
from taskloom.llm.subtrees import END, Subtree
from tests.llm import corpus


def brute(data, size):
    first = {}
    for i, t in sorted((r for r in data if r[0] is not None), key=lambda r: r[0]):
        w = corpus.words(t)
        for j in range(len(w) - size + 1):
            first.setdefault(tuple(w[j : j + size]), i)
    out = {}
    for i, t in data:
        w = corpus.words(t)
        gone = [False] * len(w)
        for j in range(len(w) - size + 1):
            if i is not None and first[tuple(w[j : j + size])] < i:
                gone[j : j + size] = [True] * size
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


@pytest.mark.parametrize(
    ("size", "group", "tree", "heavy", "held"),
    [(13, 1 << 20, 1 << 20, 1 << 20, 1 << 20), (13, 500, 300, 1 << 20, 700), (13, 500, 300, 8, 700), (3, 300, 300, 20, 1 << 20), (1, 300, 300, 50, 5000)],
)
def test_against_brute_force(spark, monkeypatch, size, group, tree, heavy, held):
    """Small groups too, so that prefixes grow long, and windows that are too frequent for a group."""
    for name, value in (("GROUP_SUFFIXES", group), ("TREE_SUFFIXES", tree), ("HEAVY", heavy), ("HELD", held)):
        monkeypatch.setattr(suffixes, name, value)
    data = [*corpus.rows(4), (None, corpus.rows(4)[0][1], None, None, None)]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in suffixes.dedupe_substrings(corpus.frame(spark, data), size, digests=True).collect()}
    assert got == brute([(r[0], r[1]) for r in data], size)


def test_windows_are_compared_by_words():
    """All suffixes in one group, whatever their labels: its nodes are the windows that repeat, by their words."""
    data = [(r[0], r[1]) for r in corpus.rows(4)[:40]]
    rows, spans = [], list(_words.spans_of(pa.array([t for _, t in data])))
    plan = suffixes._Plan([13], 1, [], np.zeros(0, np.uint64))
    for g in spans:
        at, of, position = suffixes._starts(g.edges, 13)
        doc = np.array([data[g.first + i][0] for i in of.tolist()])
        order = np.lexsort((position, doc))
        rows += [b for _, b in suffixes._spelled(plan, 1, g, at[order], doc[order], position[order])]
    blobs = [_blobs.unpack(_blobs.unsqueeze(b)) for b in rows]
    tree = Subtree(suffixes._numbered(blobs, 13))
    doc, position = (np.concatenate(c) for c in zip(*[suffixes._unplaced(*b[3:]) for b in blobs]))
    words = {i: corpus.words(t) for i, t in data}
    window = [tuple(words[d][p : p + 13]) for d, p in zip(doc.tolist(), position.tolist(), strict=True)]
    nodes = {frozenset(tree.order[a:b].tolist()) for a, b in zip(*tree.deep(13), strict=True)}
    want = {}
    for i, w in enumerate(window):
        want.setdefault(w, set()).add(i)
    assert nodes == {frozenset(x) for x in want.values() if len(x) > 1} and nodes


def test_maximal_repeats_by_enumeration():
    """All repeats of a text that can't grow on either side, and the order and common prefixes they are read from."""
    rng = np.random.default_rng(1)
    text = np.append(rng.integers(0, 3, 60), END)
    n = len(text) - 1
    rows = np.full((n, n), END)
    for i in range(n):
        rows[i, : n - i] = text[i:n]
    tree = Subtree(rows)
    plain = [tuple(text[i:n].tolist()) for i in range(n)]
    assert tree.order.tolist() == sorted(range(n), key=lambda i: plain[i])
    assert tree.lcp.tolist()[1:] == [len(os.path.commonprefix([plain[a], plain[b]])) for a, b in itertools.pairwise(tree.order.tolist())]
    want = set()
    for d in range(2, n):
        places = {}
        for i in range(n - d + 1):
            places.setdefault(plain[i][:d], []).append(i)
        for at in places.values():
            left = {text[i - 1] if i else ("start", i) for i in at}
            right = {text[i + d] if i + d < n else ("end", i) for i in at}
            if len(at) > 1 and len(left) > 1 and len(right) > 1:
                want.add((d, tuple(at)))
    got = tree.maximal_repeats(2, np.concatenate(([END], text[: n - 1])))
    assert {(d, tuple(sorted(p.tolist()))) for d, p in got} == want


@pytest.mark.parametrize("total", [10**7, 10**10, 10**12, 10**14])
def test_plans_of_any_size_send_one_record_a_suffix(total):
    """What a task sends doesn't grow with the corpus: a record of bounded size for each suffix at most."""
    slots = suffixes._slots(total)
    levels = suffixes._levels(13, total, slots)
    assert slots <= 1 << 22 and levels[-1] == 13 and (len(levels) == 1) == (total > 10**12)
    rng = np.random.default_rng(1)
    n = 5000
    label = rng.integers(0, 2**64, n, np.uint64)
    doc, position = np.repeat(np.arange(n // 100), 100), np.tile(np.arange(100), n // 100)
    sent = list(suffixes._send(max(8, total // suffixes.GROUP_SUFFIXES), label, doc, position))
    assert len(sent) <= n and sum(len(b) for _, b in sent) <= 90 * n
    back = [(_blobs.unpack(b)[0], *suffixes._unplaced(*_blobs.unpack(b)[1:])) for _, b in sent]
    assert sorted(zip(*[np.concatenate(c).tolist() for c in zip(*back, strict=True)], strict=True)) == sorted(zip((label & np.uint64(2**32 - 1)).tolist(), doc.tolist(), position.tolist(), strict=True))


def test_spans(spark):
    data = corpus.rows(4)
    want = set()
    first = {}
    for j, u, *_ in data:
        w = corpus.words(u)
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), set()).add(j)
    for i, t, *_ in data:
        w = corpus.words(t)
        gone = np.zeros(len(w) + 1, bool)
        for k in range(len(w) - 12):
            if min(first[tuple(w[k : k + 13])]) < i:
                gone[k : k + 13] = True
        edge = np.diff(np.concatenate(([0], gone.astype(int))))
        want |= {(i, int(a), int(b - a)) for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)}
    got = {tuple(r) for r in suffixes.repeated_spans(corpus.frame(spark, data), 13).collect()}
    assert got == want and want


def test_texts_lose_passages_only(spark):
    passage = " ".join(f"p{i}" for i in range(20))
    data = [(1, f"a\n{passage}\nb", None, None, 1), (2, f"c\n{passage}\n\nd  e", None, None, 1), (3, "x  y\n", None, None, 1), (4, None, None, None, 1), (5, passage, None, None, 1)]
    df = corpus.frame(spark, data).withColumnRenamed("lang", "n_words")
    got = {r.doc_id: r for r in suffixes.dedupe_substrings(df, 13).collect()}
    assert {k: r.text for k, r in got.items()} == {1: f"a\n{passage}\nb", 2: "c\nd  e", 3: "x  y\n", 4: None, 5: ""}
    assert [got[k].n_removed for k in range(1, 6)] == [0, 20, 0, 0, 20]
    assert sorted(got[1].asDict()) == ["doc_id", "n_chars", "n_removed", "n_words", "source", "text"]
    assert suffixes.dedupe_substrings(df.limit(0), 13).count() == 0


def test_rows_of_one_key_are_one_document(spark):
    passage = " ".join(f"p{i}" for i in range(13))
    data = [(1, passage, None, None, 1), (1, passage, None, None, 1), (2, passage, None, None, 1)]
    got = sorted((r.doc_id, r.n_removed) for r in suffixes.dedupe_substrings(corpus.frame(spark, data), 13).collect())
    assert got == [(1, 0), (1, 0), (2, 13)]


def test_cover():
    assert suffixes._covered(6, np.array([1, 2]), 3).tolist() == [False, True, True, True, True, False]
