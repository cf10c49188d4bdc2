"""Fan-out over lists and DataFrames, concurrent tasks, and datasets inside tasks."""

from __future__ import annotations

import asyncio
import functools
import time
from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taskloom import scope
from taskloom.errors import TaskError
from taskloom.operators.task import Task
from taskloom.plans.backends import active_backends

INDEX = "map_index"


def _as_task(func: Any) -> Task:
    if isinstance(func, Task):
        return func
    if isinstance(func, type) or not callable(func):
        raise TypeError(f"{func!r} is neither a task nor a function")
    return Task(func)


def _element(task: Task) -> Callable:
    """A call on one element that gives a value: streams are drained, coroutines awaited."""
    if task.is_generator and task.is_async:

        async def drain(*a: Any) -> list:
            return [x async for x in task(*a)]

        return lambda *a: asyncio.run(drain(*a))
    if task.is_generator:
        return lambda *a: list(task(*a))
    if task.is_async:
        return lambda *a: asyncio.run(task(*a))
    return task


def map_tasks(task: Any, *iterables: Iterable[Any], backend: str | None = None) -> list[Any]:
    """The task on each tuple of the zipped iterables, in order; the shortest one ends it.

    All elements run; then the error of the lowest index, if any, is raised.
    Inside a task the default strategy is "inline".
    """
    task = _as_task(task)
    calls = list(zip(*iterables, strict=False)) if iterables else []
    if not calls:
        return []
    name = backend or ("inline" if scope.current_task() else scope.backend_name(task.backend))
    found = active_backends().get(name)(_element(task), calls)
    for error, _ in found:
        if error is not None:
            raise error
    return [value for _, value in found]


async def gather_tasks(task: Any, *iterables: Iterable[Any], backend: str | None = None) -> list[Any]:
    """An async task on all tuples at once, in order, in the caller's event loop.

    A strategy may be named, as for ``map_tasks``, and has to exist; the loop is what runs the task.
    """
    task = _as_task(task)
    if backend is not None:
        active_backends().get(backend)
    if not task.is_async:
        raise TypeError(f"{task.base_name} isn't async")

    async def one(index: int, args: tuple) -> Any:
        with scope.at_index(index):
            if task.is_generator:
                return [x async for x in task(*args)]
            return await task(*args)

    return list(await asyncio.gather(*[one(i, a) for i, a in enumerate(zip(*iterables, strict=False))]))


def gather_actions(*actions: Callable[[], Any]) -> list[Any]:
    """Spark actions side by side, each in a thread with the caller's context; results in order."""

    async def run() -> list[Any]:
        return list(await asyncio.gather(*[asyncio.to_thread(a) for a in actions]))

    return asyncio.run(run())


def _settled(df: DataFrame) -> DataFrame:
    context, folder = df.sparkSession.sparkContext, df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if not context.getCheckpointDir() and folder:
        context.setCheckpointDir(folder)
    if context.getCheckpointDir():
        return df.checkpoint()
    if not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return df.persist()


def indexed(df: DataFrame, *order: str | Column, bucket_rows: int = 100_000) -> DataFrame:
    """Adds ``map_index`` (from 0) in the order of the given keys, without a sort by one task.

    Rows are dealt out by ranges of the keys and numbered within their range;
    counts of the ranges before give the rest. The keys should tell rows apart.
    Ranges are settled once: the dealt rows are checkpointed in the shared
    folder, or persisted on a local master without one.
    """
    ordered = df.withColumn("__key", F.struct(*order))
    total = df.count()
    parts = max(1, -(-total // bucket_rows))
    if parts == 1:
        return ordered.withColumn(INDEX, F.row_number().over(Window.orderBy("__key")).cast("long") - 1).drop("__key")
    ranged = ordered.repartitionByRange(parts, "__key").withColumn("__part", F.spark_partition_id())
    ranged = _settled(ranged)
    sizes = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select(F.col("__part").alias("__of"), F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    numbered = ranged.withColumn("__row", F.row_number().over(Window.partitionBy("__part").orderBy("__key")))
    # One row for each range; Spark broadcasts them where they are few enough.
    placed = numbered.join(before, F.col("__part") == F.col("__of"))
    return placed.withColumn(INDEX, F.col("__row").cast("long") - 1 + F.col("__before")).drop("__key", "__part", "__row", "__of", "__before")


def zip_frames(*frames: DataFrame) -> DataFrame:
    """Indexed frames side by side, as far as the shortest: an inner join on ``map_index``."""
    if not frames:
        raise ValueError("nothing to zip")
    return functools.reduce(lambda a, b: a.join(b, INDEX), frames)


def map_frame(task: Any, df: DataFrame, *columns: str | Column, result: str = "result") -> DataFrame:
    """Adds the task's result on columns, as an expression of the plan."""
    task = _as_task(task)
    return df.withColumn(result, task.column(*[F.col(c) if isinstance(c, str) else c for c in columns]))


def map_or_first_error(task: Any, df: DataFrame, *columns: str, result: str = "result") -> DataFrame:
    """As ``map_frame`` over rows with ``map_index``, but raises the error of the lowest index.

    Errors are kept beside the results, so which one is raised doesn't depend
    on which task Spark sees failing first. This runs the plan.
    """
    task = _as_task(task)
    run, kind = task.row_function(), task.result_type()

    def caught(*a: Any) -> tuple[Any, str | None]:
        try:
            return run(*a), None
        except Exception as e:
            return None, str(e)

    both = T.StructType([T.StructField("ok", kind), T.StructField("err", T.StringType())])
    tried = df.withColumn("__tried", F.udf(caught, both, useArrow=True)(*[F.col(c) for c in columns])).persist()
    failed = first_error(tried, F.col("__tried.err")).first()
    if failed and failed["err"] is not None:
        tried.unpersist()
        raise TaskError(f"Task '{task.base_name}[{failed[INDEX]}]' failed with error: {failed['err']}")
    return tried.withColumn(result, F.col("__tried.ok")).drop("__tried")


def first_error(df: DataFrame, error: Column) -> DataFrame:
    """One row (err, map_index): the error of the lowest index; nulls if there is none."""
    index = F.when(error.isNotNull(), F.col(INDEX))
    return df.agg(F.min_by(error, index).alias("err"), F.min(index).alias(INDEX))


def flat_map(task: Any, df: DataFrame, *columns: str | Column, value: str = "value", keep_empty: bool = False) -> DataFrame:
    """A row for each item that a stream task gives, with ``iter_index``.

    Inputs without items have no row, or with ``keep_empty`` one of nulls. A
    ``column`` mode task gives an array column.
    """
    made = map_frame(task, df, *columns, result="__items")
    explode = F.posexplode_outer if keep_empty else F.posexplode
    kept = [F.col(c) for c in df.columns]
    return made.select(*kept, explode("__items").alias("iter_index", value))


def table_function(task: Any, result: str = "value") -> Any:
    """A Spark table function of a stream task: a row for each item, sent as the stream gives it, for ``lateralJoin`` or SQL."""
    task = _as_task(task)
    if not task.is_generator or task.is_async:
        raise TypeError(f"{task.base_name} is no stream")
    items = task.result_type()
    run = task.func

    class Rows:
        def eval(self, *args: Any) -> Any:
            for item in run(*args):
                yield (item,)

    return F.udtf(Rows, returnType=T.StructType([T.StructField(result, items.elementType)]))


def chain(*tasks: Callable) -> Callable:
    """One after the other, each on the result of the one before."""

    def run(value: Any) -> Any:
        return functools.reduce(lambda v, t: t(v), tasks, value)

    return run


def save_dataset(key: str, value: Any, *, format: str | None = None, store: Any = None, options: dict | None = None) -> str:
    """Writes to the nearest store, with its hooks, and returns the full path."""
    hooks, metadata = scope.hooks(), scope.current_task()
    facts = {"key": key, "value": value, "format": format, "options": options, "metadata": metadata}
    hooks.call("before_dataset_save", **facts)
    path = scope.dataset_store(store).save(key, value, format, options)
    hooks.call("after_dataset_save", **facts)
    return path


def load_dataset(key: str, return_type: type | None = None, *, format: str | None = None, store: Any = None, options: dict | None = None, schema: Any = None) -> Any:
    """Reads from the nearest store, with its hooks."""
    hooks, metadata, began = scope.hooks(), scope.current_task(), time.perf_counter()
    facts = {"key": key, "return_type": return_type, "format": format, "options": options, "metadata": metadata}
    hooks.call("before_dataset_load", **facts)
    value = scope.dataset_store(store).load(key, return_type, format, options, schema)
    hooks.call("after_dataset_load", **facts, result=value, duration=time.perf_counter() - began)
    return value


