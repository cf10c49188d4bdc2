"""Each stage of the pipeline against what brute force says of its own input, and the SQL of the queries."""

import os
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from taskloom.llm import oracles, queries
from tests.llm import corpus
from tests.llm.test_similar import brute as components
from tests.llm.test_suffixes import brute as substrings
from tests.test_entry import comparable

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """(name, input rows, output rows) of each stage."""
    root = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = []
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, SF)
        made.write.parquet(str(root / name))
        after = spark.read.parquet(str(root / name))
        out.append((name, docs.collect(), after.collect(), after.columns))
        docs = after
    return {x[0]: x[1:] for x in out}


def test_columns_and_order(stages):
    assert list(stages) == ["quality", "near_duplicates", "repeated_passages", "mixture", "sentencepiece"]
    for name, (_, _, columns) in stages.items():
        assert name == "sentencepiece" or columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_quality_rejects_and_keeps(spark, stages):
    before, after, _ = stages["quality"]
    kept = {r.doc_id for r in after}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = [i for i, y in labels.items() if y == 1]
    bad = [i for i, y in labels.items() if y == 0]
    assert len(kept) < len(before) and sum(i in kept for i in good) >= 0.98 * len(good) and sum(i in kept for i in bad) <= 0.2 * len(bad)


def test_one_of_each_group_stays(stages):
    before, after, _ = stages["near_duplicates"]
    want = {i for i, (_, c) in components([(r.doc_id, r.text) for r in before], 5, 80).items() if c == i}
    assert {r.doc_id for r in after} == want
    texts = {r.doc_id: r.text for r in before}
    assert all(texts[r.doc_id] == r.text for r in after)


def test_passages_are_cut(stages):
    before, after, _ = stages["repeated_passages"]
    want = substrings([(r.doc_id, r.text) for r in before], corpus_pipeline.PASSAGE)
    texts = {r.doc_id: r.text for r in before}
    assert {r.doc_id for r in after} == set(texts)
    for r in after:
        total, gone, _ = want[r.doc_id]
        assert len(corpus.words(r.text)) == total - gone and (gone or r.text == texts[r.doc_id]) and (not gone or r.n_chars == len(r.text))


def test_mixture_meets_its_targets(stages):
    """Shares of words by every margin of the stage's own output, as near as a few documents allow; texts are as they were."""
    before, after, _ = stages["mixture"]
    texts = {r.doc_id: r.text for r in before}
    assert 0 < len(after) < len(before) and all(texts[r.doc_id] == r.text for r in after)
    words = {r.doc_id: len(corpus.words(r.text)) for r in before}
    have, got = Counter(), Counter()
    for rows, out in ((before, have), (after, got)):
        for r in rows:
            out[r.source if r.source in corpus_pipeline.MIXTURE.targets["source"] else "*"] += words[r.doc_id]
    for name, share in corpus_pipeline.MIXTURE.targets["source"].items():
        # No nearer than half of the longest document.
        assert abs(got[name] / sum(got.values()) - share) <= 0.02 + 0.5 * max(words.values()) / sum(got.values())


def test_pieces_give_the_text_back(stages):
    before, after, _ = stages["sentencepiece"]
    texts = {r.doc_id: r.text for r in before}
    assert {r.doc_id for r in after} == set(texts)
    assert all(r.decoded == texts[r.doc_id].replace("▁", " ") and r.n_tokens == len(r.ids) for r in after)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_odd_rows_in_each_stage(spark, tmp_path, name):
    """Nulls in every column, empty and long texts, ties, repeats, clashing names; and a table without rows."""
    passage = " ".join(f"p{i}" for i in range(60))
    data = [*corpus.rows(3), (None, f"a {passage}", None, None, None), (700, f"b {passage} c", "en", "src0", 1), (701, f"d {passage} e", "en", "src0", 1), (701, f"d {passage} e", "en", "src0", 1), (702, None, None, None, None)]
    docs = corpus.frame(spark, data)
    for c in ("score", "predicted", "component_id", "n_words", "n_removed", "mix_weight", "topic", "ids", "k", "b"):
        docs = docs.withColumn(c, F.lit("own"))
    spark.createDataFrame([(i, i % 2) for i in range(0, 80, 3)] + [(None, 1), (700, None)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    stage = dict(corpus_pipeline.STAGES)[name]
    got = stage(spark, docs, str(tmp_path)).collect()
    texts = {(r[0], r[1]) for r in data}
    if name == "sentencepiece":
        assert len(got) == len(data) and sorted(r.doc_id for r in got if r.doc_id is not None) == sorted(r[0] for r in data if r[0] is not None)
    else:
        assert got[0].__fields__ == docs.columns and all(r.topic == r.k == r.score == r.n_words == "own" for r in got)
        if name != "repeated_passages":
            assert all((r.doc_id, r.text) in texts for r in got)
    if name == "repeated_passages":
        assert len(got) == len(data) and sorted(r.text for r in got if r.doc_id in (700, 701)) == [f"b {passage} c", "d e", "d e"]
        assert [r.text for r in got if r.doc_id is None] == [f"a {passage}"] and all(r.n_chars == 3 for r in got if r.doc_id == 701)
    if name == "near_duplicates":
        want = {i for i, (_, c) in components([(r[0], r[1]) for r in data if r[0] is not None], 5, 80).items() if c == i}
        assert {r.doc_id for r in got if r.doc_id is not None} == want and sum(r.doc_id is None for r in got) == 1
    if name == "quality":
        assert len({r.text for r in got if r.doc_id == 701}) <= 1
    none = stage(spark, docs.limit(0), str(tmp_path))
    assert none.count() == 0 and (name == "sentencepiece" or none.columns == docs.columns)


def test_run_gives_the_last_stage_s_rows(spark, stages):
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).select("doc_id").collect()} == {r.doc_id for r in stages["sentencepiece"][1]}


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    want = con.sql(oracles.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert comparable(tuple(r) for r in df.select(want.columns).collect()) == comparable(want.fetchall())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(oracles.ORACLES) - {"op2_top_k"}))
def test_whole_tables(spark, name):
    """Queries that SQL can't express return a row for each document."""
    total = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert queries.QUERIES[name](spark, SF).select(F.countDistinct("doc_id"), F.count(F.lit(1))).first()[:] == (total, total)
