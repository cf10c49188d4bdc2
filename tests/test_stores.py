import pickle

import pytest
from pyspark.sql import functions as F

from taskloom import load_dataset, map_tasks, save_dataset, session, task
from taskloom.errors import TaskTimeout, Uncacheable
from taskloom.plans.cache import MISS, CacheStore, frame_key, value_key
from taskloom.sources import DatasetStore, Storage


def test_storage_rules(tmp_path):
    s = Storage(tmp_path)
    s.save("a/b.bin", b"x")
    assert s.load("a/b.bin") == b"x" and s.exists("a/b.bin") and s.list_keys() == ["a/b.bin"]
    s.delete("a/b.bin")
    s.delete("a/b.bin")
    with pytest.raises(KeyError):
        s.load("a/b.bin")
    for key in ("/etc/x", "../x", "C:\\x", "s3://bucket/x"):
        with pytest.raises(ValueError):
            s.path(key)
    assert Storage(tmp_path, outside=True).path("/etc/x") == "/etc/x"
    assert Storage.format_hint("a/Page.tar.GZ") == "gz" and Storage.format_hint("none") is None


@pytest.mark.parametrize(("key", "value"), [("t.txt", "é"), ("r.bin", b"\x00"), ("d.pkl", {"a": 1}), ("s.pickle", {1, 2}), ("l.pkl", [1]), ("o.pkl", (1, None))])
def test_values_round_trip(tmp_path, key, value):
    store = DatasetStore(str(tmp_path), trust_pickle=True)
    path = store.save(key, value)
    assert path.endswith(key) and store.load(key, type(value)) == value and store.load(key) == value


def test_pickles_need_trust(tmp_path):
    (tmp_path / "x.pkl").write_bytes(pickle.dumps(1))
    with pytest.raises(ValueError, match="trust_pickle"):
        DatasetStore(str(tmp_path)).load("x.pkl")


@pytest.mark.parametrize("fmt", ["parquet", "orc", "json", "csv"])
def test_frames_round_trip(spark, tmp_path, fmt):
    df = spark.createDataFrame([(1, "a"), (2, "b,c")], "k long, v string")
    store = DatasetStore(str(tmp_path))
    store.save(f"x.{fmt}", df)
    assert sorted(tuple(r) for r in store.load(f"x.{fmt}", schema=df.schema).collect()) == [(1, "a"), (2, "b,c")]
    assert store.list_keys() == [f"x.{fmt}"]


def test_task_output_by_index(spark, tmp_path):
    @task(dataset="out_{map_index}_{x}.txt")
    def name(x):
        return f"v{x}"

    with session(dataset_store=str(tmp_path)):
        for backend in ("inline", "threads", "distributed"):
            map_tasks(name, [5, 6], backend=backend)
            assert sorted(p.name for p in tmp_path.glob("*.txt")) == ["out_0_5.txt", "out_1_6.txt"]
            for p in tmp_path.glob("*.txt"):
                p.unlink()
        assert save_dataset("k.txt", "hello").endswith("k.txt") and load_dataset("k.txt") == "hello"


def test_cache_entries(tmp_path):
    now = [100.0]
    store = CacheStore(str(tmp_path), clock=lambda: now[0])
    assert store.get("abc123") is MISS
    store.put("abc123", None)
    assert store.get("abc123") is None
    store.put("abc123", 5, ttl=10)
    now[0] = 111
    assert store.get("abc123") is MISS and not list(tmp_path.rglob("*.pkl"))
    store.put("abc123", 5)
    (tmp_path / "ab" / "c123.meta.json").write_text("{")
    assert store.get("abc123") is MISS
    (tmp_path / "note.txt").write_text("mine")
    store.put("abd456", 1)
    store.clear()
    assert store.get("abd456") is MISS and (tmp_path / "note.txt").exists()
    with pytest.raises(ValueError):
        store.get("zz")


def test_cached_task(tmp_path):
    runs = []

    @task(cache=True)
    def square(x):
        runs.append(x)
        return x * x

    with session(cache_store=str(tmp_path)):
        assert [square(3), square(3), square(4)] == [9, 9, 16]
    with session(cache_store=str(tmp_path)):
        assert square(3) == 9
    with session(cache_store="off"):
        square(3)
    assert runs == [3, 4, 3]


def test_value_keys_tell_kinds_apart():
    def f(x):
        return x

    keys = [value_key(f, {"x": v}) for v in ({1, 2}, [1, 2], (1, 2), frozenset({3}), {"a": 1}, {"a": 2})]
    assert len(set(keys)) == len(keys)
    assert value_key(f, {"x": {"a": 1, "b": 2}}) == value_key(f, {"x": {"b": 2, "a": 1}})


def test_frame_keys_follow_files(spark, tmp_path):
    for name in ("a", "b"):
        spark.range(3).coalesce(1).write.parquet(str(tmp_path / name))
    key = lambda name: frame_key(spark.read.parquet(str(tmp_path / name)).where("id > 1"))
    first = key("a")
    assert first == key("a") and first != key("b")
    assert frame_key(spark.read.parquet(str(tmp_path / "a")).where("id > 2")) != first
    spark.range(5).coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "a"))
    assert key("a") != first


def test_frames_without_a_safe_key(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "a"))
    files = spark.read.parquet(str(tmp_path / "a"))
    local = spark.createDataFrame([(1,)], "id long")
    for df in (local, files.join(local, "id"), files.select(F.rand()), files.select(F.udf(lambda x: x, "long")("id")), files.mapInPandas(lambda b: b, "id long")):
        with pytest.raises(Uncacheable):
            frame_key(df)


def test_cached_table_runs_no_second_time(spark, tmp_path):
    spark.range(10).write.parquet(str(tmp_path / "in"))
    runs = []

    @task(mode="table", cache=True)
    def evens(df):
        runs.append(1)
        return df.where("id % 2 = 0")

    with session(cache_store=str(tmp_path / "cache")):
        for _ in range(2):
            assert evens(spark.read.parquet(str(tmp_path / "in"))).count() == 5
    assert runs == [1]


def test_an_entry_is_replaced_at_once(spark, tmp_path, monkeypatch):
    """A put that fails leaves the entry before; one that succeeds leaves no data of it."""
    store = CacheStore(str(tmp_path))
    store.put("abc123", spark.range(3))
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        store.put("abc123", spark.range(3).select(F.expr("id / (id - id)").alias("id")).where("id > 0 or id / 0 > 1"))
    assert store.get("abc123").count() == 3
    store.put("abc123", 5)
    assert store.get("abc123") == 5 and store.keys() == ["abc123"]
    assert [p.suffix for p in (tmp_path / "ab").glob("c123.*.p*")] == [".pkl"]


def test_nothing_is_written_after_a_time_limit(tmp_path):
    import time

    @task(timeout=0.2, cache=True, dataset="late.txt", dataset_store=str(tmp_path / "data"))
    def late():
        time.sleep(0.6)
        return "x"

    with session(cache_store=str(tmp_path / "cache")), pytest.raises(TaskTimeout):
        late()
    time.sleep(0.8)
    assert not list(tmp_path.rglob("*.*"))


def test_frame_keys_ask_for_folders_not_files(spark, tmp_path):
    spark.range(50).repartition(25).write.parquet(str(tmp_path / "many"))
    df = spark.read.parquet(str(tmp_path / "many"))
    assert frame_key(df) == frame_key(spark.read.parquet(str(tmp_path / "many")))
    first = frame_key(df)
    (tmp_path / "many" / "extra.parquet").write_bytes(next((tmp_path / "many").glob("part-*.parquet")).read_bytes())
    assert frame_key(spark.read.parquet(str(tmp_path / "many"))) != first
