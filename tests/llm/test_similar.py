from collections import Counter

import numpy as np
import pytest

from taskloom.llm import similar
from taskloom.llm._graph import components
from taskloom.llm._store import Workspace
from taskloom.llm.signatures import SignatureTree, linked
from tests.llm import corpus


def sets(data, size):
    out = {}
    for i, t in data:
        w = corpus.words(t, lower=True)
        out[i] = {tuple(w[j : j + size]) for j in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    return out


def link_counts(data, size, percent):
    found = sets(data, size)
    return {i: sum(j != i and bool(found[i] and found[j]) and 100 * len(found[i] & found[j]) >= percent * len(found[i] | found[j]) for j in found) for i in found}


def brute(data, size, percent):
    found = sets(data, size)
    holders, parent = {}, {i: i for i in found}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sorted(found):
        shared = Counter(j for s in found[i] for j in holders.get(s, ()))
        for j, n in shared.items():
            if 100 * n >= percent * (len(found[i]) + len(found[j]) - n):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
        for s in found[i]:
            holders.setdefault(s, []).append(i)
    return {i: (len(found[i]), find(i)) for i in found}


@pytest.mark.parametrize(("size", "percent", "block"), [(4, 85, 8 << 20), (5, 80, 4000), (3, 60, 2000), (2, 100, 8 << 20)])
def test_all_links_are_found(spark, monkeypatch, size, percent, block):
    """Blocks and families of a few sets too, so that they are split and cut."""
    monkeypatch.setattr(similar, "BLOCK_BYTES", block)
    monkeypatch.setattr(similar, "TASK_ROWS", 512 if block > 4000 else 3)
    data = [(r[0], r[1]) for r in corpus.rows(size)]
    got = similar.jaccard_components(corpus.frame(spark, corpus.rows(size)), size, percent, counts=True).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(data, size, percent)
    assert {r.doc_id: r.n_links for r in got} == link_counts(data, size, percent)


def test_without_the_first_blocks_nothing_is_lost(spark, monkeypatch):
    """The third step alone finds all links between different sets."""
    monkeypatch.setattr(similar, "_near_links", lambda *a: None)
    data = corpus.rows(9)
    got = {r.doc_id: r.component_id for r in similar.jaccard_components(corpus.frame(spark, data), 4, 85).collect()}
    assert got == {i: c for i, (_, c) in brute([(r[0], r[1]) for r in data], 4, 85).items()}


def test_nulls_repeats_and_empty_tables(spark):
    data = [(None, "a b c d e", None, None, None), (3, "a b c d e", None, None, None), (3, "a b c d e", None, None, None), (1, "A b c d e", None, None, None), (7, "", None, None, None)]
    df = corpus.frame(spark, data)
    got = sorted(similar.jaccard_components(df, 4, 85).collect(), key=str)
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got if r.doc_id is not None) == [(1, 2, 1), (3, 2, 1), (3, 2, 1), (7, 0, 7)]
    assert [(r.n_shingles, r.component_id) for r in got if r.doc_id is None] == [(2, None)]
    assert similar.jaccard_components(df.limit(0), 4, 85, counts=True).count() == 0
    assert sorted((r.doc_id, r.n_links) for r in similar.jaccard_components(df, 4, 85, counts=True).collect() if r.doc_id is not None) == [(1, 1), (3, 1), (3, 1), (7, 0)]


@pytest.mark.parametrize("percent", [60, 85, 100])
def test_links_within_are_counted(percent):
    rng = np.random.default_rng(percent)
    base = np.unique(rng.integers(0, 2**63, 60).astype(np.uint64))
    made = [np.sort(np.concatenate((base[rng.random(len(base)) < 0.9], rng.integers(0, 2**63, int(rng.integers(0, 5))).astype(np.uint64)))) for _ in range(40)] + [base, base]
    weights, side = rng.integers(1, 5, len(made)), rng.random(len(made)) < 0.5
    both = [[i != j and linked(made[i], made[j], percent) for j in range(len(made))] for i in range(len(made))]
    assert similar.links_within(made, percent, weights).tolist() == [sum(w for j, w in enumerate(weights.tolist()) if both[i][j]) for i in range(len(made))]
    assert similar.links_within(made, percent, weights, side).tolist() == [sum(w for j, w in enumerate(weights.tolist()) if both[i][j] and side[i] != side[j]) for i in range(len(made))]


@pytest.mark.parametrize("percent", [60, 85])
def test_tree_joins_what_links_join(percent):
    rng = np.random.default_rng(percent)
    base = [np.unique(rng.integers(0, 2**63, 80).astype(np.uint64)) for _ in range(5)]
    made = []
    for k in range(150):
        s = base[k % 5][rng.random(len(base[k % 5])) < rng.uniform(0.75, 1)]
        made.append(np.unique(np.concatenate((s, rng.integers(0, 2**63, int(rng.integers(0, 12))).astype(np.uint64)))))
    parent = list(range(len(made)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def classes(links):
        for i in range(len(made)):
            parent[i] = i
        for i, j in links:
            parent[max(find(i), find(j))] = min(find(i), find(j))
        return [find(i) for i in range(len(made))]

    want = [(i, j) for i in range(len(made)) for j in range(i) if linked(made[i], made[j], percent)]
    got = SignatureTree(made, percent).links()
    assert all(linked(made[i], made[j], percent) for i, j in got)
    assert classes(got) == classes(want)


def test_parity_never_exceeds_the_difference():
    rng = np.random.default_rng(2)
    for _ in range(200):
        a = np.unique(rng.integers(0, 300, 150).astype(np.uint64))
        b = np.unique(rng.integers(0, 300, 150).astype(np.uint64))
        x, y = (np.frombuffer(similar._parity(s), np.uint64) for s in (a, b))
        if len(x) == len(y):
            assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 140)] + [(200, 200), (139, 300)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(links, "u long, v long"), Workspace(spark, "t"), "c").collect())
    assert got == {**{i: 0 for i in range(61)}, **{k: 100 for k in [*range(100, 140), 300]}}


@pytest.mark.parametrize(("size", "percent"), [(4, 85), (3, 60), (2, 100)])
def test_every_link_is_an_output(spark, size, percent):
    """Pairs within one component too: each verified link, and each document's number of them."""
    data = [(r[0], r[1]) for r in corpus.rows(size)]
    found = sets(data, size)
    want = {}
    for i in found:
        for j in found:
            shared = len(found[i] & found[j])
            if i < j and found[i] and 100 * shared >= percent * len(found[i] | found[j]) and found[j]:
                want[i, j] = shared
    links, rows = similar.jaccard_links(corpus.frame(spark, corpus.rows(size)), size, percent)
    rows = {r.doc_id: r for r in rows.collect()}
    assert {i: (r.n_shingles, r.n_links) for i, r in rows.items()} == {i: (len(s), sum(i in p for p in want)) for i, s in found.items()}
    assert {i: r.set_id for i, r in rows.items()} == {i: min(j for j in found if found[j] == s) if s else None for i, s in found.items()}
    got = [tuple(r) for r in links.collect()]
    assert sorted(got) == sorted((i, j, n) for (i, j), n in want.items() if rows[i].set_id == i and rows[j].set_id == j and found[i] != found[j])


def test_links_of_nulls_repeats_and_empty_tables(spark):
    data = [(None, "a b c d e", None, None, None), (3, "a b c d e", None, None, None), (3, "a b c d e", None, None, None), (1, "A b c d e", None, None, None), (7, "", None, None, None)]
    df = corpus.frame(spark, data)
    links, rows = similar.jaccard_links(df, 4, 85)
    assert links.count() == 0
    assert sorted((tuple(r) for r in rows.collect()), key=str) == sorted([(None, 2, None, 0), (3, 2, 1, 1), (3, 2, 1, 1), (1, 2, 1, 1), (7, 0, None, 0)], key=str)
    links, rows = similar.jaccard_links(df.limit(0), 4, 85)
    assert links.count() == 0 and rows.count() == 0
