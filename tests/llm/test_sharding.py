from collections import Counter

import pytest

from taskloom.llm import sharding
from tests.llm import corpus


@pytest.mark.parametrize("bucket", [3, 20_000])
def test_shards_match_the_mixture(spark, monkeypatch, bucket):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", bucket)
    df = corpus.frame(spark)
    got = sharding.shard(df, 4).collect()
    total = df.count()
    assert len(got) == total and {len(r) for r in got} == {7}
    sizes = Counter(r.shard for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    for k, n in sizes.items():
        assert sorted(r.slot for r in got if r.shard == k) == list(range(n))
    whole = Counter(r.source for r in got)
    for k, n in sizes.items():
        for s, c in Counter(r.source for r in got if r.shard == k).items():
            assert abs(c - whole[s] * n / total) < 2
    again = {r.doc_id: (r.shard, r.slot) for r in sharding.shard(df.repartition(7), 4).collect()}
    assert again == {r.doc_id: (r.shard, r.slot) for r in got}


@pytest.mark.parametrize("bucket", [7, 20_000])
def test_groups_stay_together(spark, monkeypatch, bucket):
    """Rows of a group are neighbours in their stratum, however large it is; counts and shares are met as without groups."""
    monkeypatch.setattr(sharding, "BUCKET_ROWS", bucket)
    data = [(i, f"t{i % 40}" if i % 3 else "hot", "s" if i % 5 else "r") for i in range(1200)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string").repartition(5)
    got = sharding.shard(df, 4, group="text").collect()
    sizes = Counter(r.shard for r in got)
    assert set(sizes.values()) == {300} and all(sorted(r.slot for r in got if r.shard == k) == list(range(300)) for k in sizes)
    for k in sizes:
        assert abs(sum(r.shard == k and r.source == "r" for r in got) - 60) < 2
    # In a stratum at most one group for each cut lies on both sides of it.
    for s in ("s", "r"):
        spread = Counter(t for t, _ in {(r.text, r.shard) for r in got if r.source == s})
        assert sum(n - 1 for n in spread.values()) <= 3
    assert {r.doc_id: (r.shard, r.slot) for r in sharding.shard(df.coalesce(1), 4, group="text").collect()} == {r.doc_id: (r.shard, r.slot) for r in got}


def test_ties_nulls_and_names(spark):
    data = [(None, "a", None), (None, "a", None), (1, "b", "s"), (1, "b", "s"), (1, "c", "s")]
    df = spark.createDataFrame(data, "doc_id long, slot string, source string")
    got = sharding.shard(df, 2).collect()
    assert got[0].__fields__ == ["doc_id", "source", "shard", "slot"]
    assert sorted((r.shard, r.slot) for r in got) == [(0, 0), (0, 1), (1, 0), (1, 1), (1, 2)]
    assert sharding.shard(df.limit(0), 2).count() == 0
    with pytest.raises(ValueError):
        sharding.shard(df, 0)


def test_written_shards(spark, tmp_path):
    placed = sharding.shard(corpus.frame(spark).select("doc_id", "source"), 3)
    sharding.write_shards(placed, str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out").glob("shard=*")) == ["shard=0", "shard=1", "shard=2"]
    assert spark.read.parquet(str(tmp_path / "out")).count() == placed.count()


def test_no_python_in_the_plan(spark):
    plan = sharding.shard(corpus.frame(spark), 4, group="text")._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Arrow", "Pandas"))
