import asyncio
import time

import pytest
from pyspark.sql import functions as F

from taskloom import Task, gather_tasks, map_tasks, session, task
from taskloom.errors import BackendError, TaskError, TaskTimeout


class Recorder:
    def __init__(self):
        self.calls = []

    def before_node_execute(self, metadata):
        self.calls.append(("before", metadata.name))

    def after_node_execute(self, metadata, result, duration):
        self.calls.append(("after", metadata.name, result))

    def before_node_retry(self, metadata, attempt):
        self.calls.append(("retry", attempt))

    def after_node_retry(self, attempt, succeeded):
        self.calls.append(("retried", attempt, succeeded))

    def on_node_error(self, metadata, error):
        self.calls.append(("error", str(error)))

    def node_iteration(self, metadata, index):
        self.calls.append(("item", index))


def test_runs_at_once():
    @task
    def add(x: int, y: int = 2) -> int:
        """Adds."""
        return x + y

    assert isinstance(add, Task) and add(1) == 3 and add(x=1, y=5) == 6
    assert add.description == "Adds."


def test_rejects_what_is_no_function():
    with pytest.raises(TypeError):
        task(int)
    with pytest.raises(TypeError):
        task(3)
    with pytest.raises(ValueError, match="unknown parameters"):
        task(name="{nope}")(lambda x: x)


def test_generators_reject_options():
    def stream(n: int):
        yield n

    for options in ({"cache": True}, {"retries": 1}, {"timeout": 1.0}):
        with pytest.raises(ValueError, match="generator"):
            task(**options)(stream)


def test_retries_and_hooks():
    rec, tries = Recorder(), []

    @task(retries=2)
    def flaky():
        tries.append(1)
        if len(tries) < 3:
            raise RuntimeError("no")
        return "ok"

    with session(plugins=[rec]):
        assert flaky() == "ok"
    assert len(tries) == 3
    assert rec.calls == [("before", "flaky"), ("retry", 1), ("retried", 1, False), ("retry", 2), ("retried", 2, True), ("after", "flaky", "ok")]


def test_failure_message_and_cause():
    @task(retries=1)
    def broken(x):
        raise ValueError("bad")

    with pytest.raises(TaskError, match="Task 'broken' failed after 2 attempts with error: bad") as e:
        broken(1)
    assert isinstance(e.value.__cause__, ValueError)


def test_timeout_is_enforced(spark):
    @task(timeout=0.3)
    def slow():
        time.sleep(5)

    began = time.time()
    with pytest.raises(TaskTimeout):
        slow()
    assert time.time() - began < 3

    @task(timeout=2.0)
    def slow_job():
        return spark.range(4).select(F.udf(lambda x: time.sleep(15) or x, "long")("id")).collect()

    began = time.time()
    with pytest.raises(TaskTimeout):
        slow_job()
    while spark.sparkContext.statusTracker().getActiveJobsIds():
        assert time.time() - began < 30
        time.sleep(0.1)


def test_streams_fire_items_and_end():
    rec = Recorder()

    @task
    def count(n: int):
        for i in range(n):
            yield i

    with session(plugins=[rec]):
        assert list(count(2)) == [0, 1]
    assert rec.calls == [("before", "count"), ("item", 0), ("item", 1), ("after", "count", None)]


def test_failing_stream():
    @task
    def broken(n: int):
        yield 0
        raise RuntimeError("stop")

    stream = broken(3)
    assert next(stream) == 0
    with pytest.raises(TaskError, match="stop"):
        next(stream)


def test_async_task_and_gather():
    @task
    async def double(x):
        await asyncio.sleep(0)
        return 2 * x

    assert asyncio.run(double(4)) == 8
    assert asyncio.run(gather_tasks(double, [1, 2, 3])) == [2, 4, 6]
    assert asyncio.run(gather_tasks(double, [1, 2], backend="threads")) == [2, 4]
    with pytest.raises(BackendError):
        asyncio.run(gather_tasks(double, [1], backend="nope"))
    with pytest.raises(TypeError):
        asyncio.run(gather_tasks(lambda x: x, [1]))


@pytest.mark.parametrize("backend", ["inline", "threads", "distributed"])
def test_map_is_alike_on_all_strategies(spark, backend):
    @task
    def add(x: int, y: int) -> int:
        return x + y

    @task
    def count(n: int):
        yield from range(n)

    @task
    async def double(x):
        return 2 * x

    def three(x):
        if x >= 3:
            raise ValueError(f"{x} is bad")
        return x

    assert map_tasks(add, [1, 2, 3], [10, 20, 30, 40], backend=backend) == [11, 22, 33]
    assert map_tasks(count, [2, 0], backend=backend) == [[0, 1], []]
    assert map_tasks(double, [1, 2], backend=backend) == [2, 4]
    assert map_tasks(add, backend=backend) == map_tasks(add, [], [1], backend=backend) == []
    with pytest.raises(TaskError, match="3 is bad"):
        map_tasks(three, [1, 3, 4], backend=backend)


def test_names_by_index_and_template():
    rec = Recorder()

    @task(name="n_{x}")
    def f(x):
        return x

    @task(name="at_{map_index}")
    def g(x):
        return x

    with session(plugins=[rec]):
        f(7)
        map_tasks(f, [5])
        map_tasks(g, [5])
    assert [c[1] for c in rec.calls if c[0] == "before"] == ["n_7", "n_5[0]", "at_0"]


def test_nested_map_runs_inline(spark):
    @task
    def outer(n):
        return map_tasks(lambda x: x + 1, list(range(n)))

    with session(backend="distributed"):
        assert map_tasks(outer, [2, 3]) == [[1, 2], [1, 2, 3]]


def test_columns_agree_with_rows(spark):
    """Column, Arrow and plain calls of a function give the same, negatives and nulls included."""

    def triple(x: int) -> int | None:
        return x * 3

    df = spark.createDataFrame([(-7,), (0,), (5,)], "x long")
    column = [r[0] for r in df.select(task(mode="column")(triple)(F.col("x"))).collect()]
    rows = [r[0] for r in df.select(task(triple)(F.col("x"))).collect()]
    assert column == rows == [triple(x) for x in (-7, 0, 5)]


def test_row_task_needs_a_type(spark):
    with pytest.raises(TypeError, match="return annotation"):
        task(lambda x: x)(F.col("x"))


def test_own_strategy_is_honoured():
    with pytest.raises(BackendError):
        map_tasks(task(backend="nope")(lambda x: x), [1])
    seen = []

    @task(backend="threads")
    def where(x):
        import threading

        seen.append(threading.current_thread().name)
        return x

    assert map_tasks(where, [1]) == [1] and seen[0].startswith("taskloom")


def test_raising_hook_is_not_retried():
    runs = []

    class Bad:
        def after_node_execute(self, metadata):
            raise RuntimeError("hook")

    @task(retries=3)
    def once():
        runs.append(1)

    with session(plugins=[Bad()]), pytest.raises(RuntimeError, match="hook"):
        once()
    assert runs == [1]


def test_failing_dataset_is_inside_the_attempt(tmp_path):
    runs = []

    @task(retries=1, dataset="../outside.txt")
    def write():
        runs.append(1)
        return "x"

    with session(dataset_store=str(tmp_path)), pytest.raises(TaskError, match="after 2 attempts.*outside"):
        write()
    assert runs == [1, 1]
