import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from taskloom import chain, flat_map, indexed, map_or_first_error, task, zip_frames
from taskloom.errors import TaskError
from taskloom.streaming import pull, windowed_counts, write_once


def test_index_over_many_ranges(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"))
    rows = indexed(df, "k", bucket_rows=100).orderBy("map_index").collect()
    assert [(r.k, r.map_index) for r in rows] == [(i, i) for i in range(1000)]


@settings(max_examples=5, deadline=None)
@given(st.integers(0, 20), st.integers(0, 20))
def test_zip_is_as_long_as_the_shortest(spark, a, b):
    left = indexed(spark.range(a).withColumnRenamed("id", "l"), "l")
    right = indexed(spark.range(b).withColumnRenamed("id", "r"), "r")
    assert sorted((x.l, x.r) for x in zip_frames(left, right).collect()) == [(i, i) for i in range(min(a, b))]


def test_flat_map_keeps_empty_inputs_on_request(spark):
    @task
    def count(n: int) -> list[int]:
        return list(range(n))

    df = spark.createDataFrame([(0,), (2,)], "n long")
    assert sorted((r.n, r.iter_index, r.value) for r in flat_map(count, df, "n").collect()) == [(2, 0, 0), (2, 1, 1)]
    assert (0, None, None) in {tuple(r) for r in flat_map(count, df, "n", keep_empty=True).collect()}


def test_lowest_error_stands(spark):
    @task
    def check(x: int) -> int:
        if x % 2:
            raise ValueError(f"{x} is odd")
        return x

    df = spark.range(10).select(F.col("id").alias("map_index"), F.col("id").alias("x"))
    with pytest.raises(TaskError, match="1 is odd"):
        map_or_first_error(check, df, "x")
    assert map_or_first_error(check, df.where("x % 2 = 0"), "x").count() == 5


def test_chain():
    assert chain(lambda x: x + 1, lambda x: x * 2)(3) == 8


def test_pull_is_lazy(spark):
    rows = pull(spark.range(0, 100, 1, 4), "id")
    assert [next(rows).id for _ in range(3)] == [0, 1, 2]


def test_windows_on_batch_and_stream_agree(spark, tmp_path):
    events = spark.createDataFrame([(i, f"2024-01-0{1 + i % 3} 0{i % 9}:00:00", "ab"[i % 2]) for i in range(30)], "id long, t string, kind string")
    events = events.withColumn("ts", F.col("t").cast("timestamp"))
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    events.write.parquet(source)
    late = events.limit(1).withColumn("ts", F.lit("2024-02-01").cast("timestamp"))
    batch = windowed_counts(spark.read.parquet(source), "ts", "1 day", "kind")
    stream = spark.readStream.schema(events.schema).parquet(source)
    write_once(windowed_counts(stream, "ts", "1 day", "kind"), sink, str(tmp_path / "check"))
    late.write.mode("append").parquet(source)
    write_once(windowed_counts(stream, "ts", "1 day", "kind"), sink, str(tmp_path / "check"))
    # The second run moves the watermark past all days of the first.
    got = {tuple(r) for r in spark.read.parquet(sink).collect()}
    assert got == {tuple(r) for r in batch.collect()}
