"""Tasks: plain functions that run at once as instrumented steps, or as expressions over columns.

A call with ordinary arguments runs the function at once. A call with columns
gives a column: of the function itself in ``column`` mode, of an Arrow-backed
function in ``row`` mode. A ``table`` task takes and returns DataFrames, stays lazy, and
is written when it is cached, saved or retried.
"""

from __future__ import annotations

import asyncio
import contextvars
import functools
import inspect
import threading
import time
import typing
from collections.abc import AsyncIterator, Callable, Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taskloom import scope
from taskloom.errors import TaskError, TaskTimeout, Uncacheable
from taskloom.functions.templates import placeholders, resolve
from taskloom.functions.types import spark_type
from taskloom.plans.cache import MISS, value_key
from taskloom.plans.hooks import log

MODES = ("column", "row", "table")
_BUILT_IN = {"map_index", "iter_index"}


def _reason(error: BaseException) -> str:
    """An error's own text; of an error in a Python function on an executor, the last line of its trace."""
    text = str(error)
    if type(error).__name__ == "PythonException":
        lines = [x.strip() for x in text.splitlines() if x.strip() and not x.lstrip().startswith(("at ", "File ", "JVM"))]
        return next((x for x in reversed(lines) if ":" in x), text)
    return text


class Task:
    """A function with a name, attempts, a time limit, a cache and a dataset to write."""

    def __init__(
        self, func: Callable, *, name: str | None = None, description: str | None = None, mode: str = "row", backend: str | None = None, retries: int = 0, timeout: float | None = None,
        cache: bool = False, cache_store: Any = None, cache_ttl: int | None = None, cache_hash: Callable | None = None,
        dataset: str | None = None, dataset_store: Any = None, dataset_format: str | None = None,
    ):
        if isinstance(func, type) or not callable(func):
            raise TypeError("a task is made of a function")
        if mode not in MODES:
            raise ValueError(f"mode is one of {', '.join(MODES)}")
        self.func, self.mode, self.backend = func, mode, backend
        self.signature = inspect.signature(func)
        self.is_async = inspect.iscoroutinefunction(func) or inspect.isasyncgenfunction(func)
        self.is_generator = inspect.isgeneratorfunction(func) or inspect.isasyncgenfunction(func)
        if self.is_generator and (cache or retries or timeout is not None):
            raise ValueError("a generator can't be cached, retried or timed")
        if retries < 0 or (timeout is not None and timeout <= 0):
            raise ValueError("retries can't be negative, and a time limit must be positive")
        self.base_name = name or getattr(func, "__name__", type(func).__name__)
        self.description = description if description is not None else inspect.getdoc(func) or ""
        self.retries, self.timeout = retries, timeout
        self.cache, self.cache_store, self.cache_ttl, self.cache_hash = cache, cache_store, cache_ttl, cache_hash
        self.dataset, self.dataset_store, self.dataset_format = dataset, dataset_store, dataset_format
        for template in filter(None, (name, dataset)):
            if unknown := placeholders(template) - set(self.signature.parameters) - _BUILT_IN:
                raise ValueError(f"{template!r} names unknown parameters: {', '.join(sorted(unknown))}")
        functools.update_wrapper(self, func)

    # Columns

    def result_type(self):
        """The Spark type of the result, from the annotation; a stream's is an array."""
        hints = typing.get_type_hints(self.func)
        if "return" not in hints:
            raise TypeError(f"{self.base_name} needs a return annotation to run over columns")
        return spark_type(hints["return"])

    def column(self, *args: Column, **kwargs: Column) -> Column:
        """The task over columns; values that aren't columns are taken as literals in row mode."""
        bound = self.signature.bind(*args, **kwargs)
        bound.apply_defaults()
        if self.mode == "column":
            return self.func(*bound.args, **bound.kwargs)
        if self.mode == "table":
            raise TypeError(f"{self.base_name} takes tables, not columns")
        values = [*bound.args, *bound.kwargs.values()]
        columns = [v if isinstance(v, Column) else F.lit(v) for v in values]
        return F.udf(self.row_function(), self.result_type(), useArrow=True)(*columns)

    def row_function(self) -> Callable:
        """A plain function of one row: streams become lists, coroutines are awaited."""
        func = self.func
        if inspect.isasyncgenfunction(func):

            async def drain(*a: Any) -> list:
                return [x async for x in func(*a)]

            return lambda *a: asyncio.run(drain(*a))
        if self.is_async:
            return lambda *a: asyncio.run(func(*a))
        if self.is_generator:
            return lambda *a: list(func(*a))
        return func

    # Calls

    def _inputs(self, args: tuple, kwargs: dict) -> dict[str, Any]:
        try:
            bound = self.signature.bind(*args, **kwargs)
        except TypeError:
            return dict(kwargs)
        bound.apply_defaults()
        return dict(bound.arguments)

    def metadata(self, args: tuple, kwargs: dict) -> scope.TaskMetadata:
        inputs, index = self._inputs(args, kwargs), scope.current_index()
        known = {**inputs, **({"map_index": index} if index is not None else {})}
        name = resolve(self.base_name, known)
        if index is not None and "map_index" not in placeholders(self.base_name):
            name += f"[{index}]"
        parent = scope.current_task()
        return scope.TaskMetadata(
            scope.new_id(), name, scope.backend_name(self.backend), inputs, self.description, index, parent.id if parent else None, self.is_async, self.is_generator
        )

    def _key(self, metadata: scope.TaskMetadata) -> str | None:
        if not self.cache:
            return None
        try:
            return (self.cache_hash or value_key)(self.func, metadata.inputs)
        except Uncacheable as e:
            log.warning("%s isn't cached: %s", metadata.name, e)
            return None

    def _limited(self, run: Callable[[], Any], name: str) -> Any:
        """Runs within the time limit; on its passing, the Spark jobs that the run has started are cancelled, and what it still returns is written nowhere."""
        if self.timeout is None:
            return run()
        spark, tag, done = SparkSession.getActiveSession(), f"taskloom-limit-{scope.new_id()}", threading.Event()
        out: list[tuple[bool, Any]] = []

        expired = threading.Event()

        def work() -> None:
            try:
                if spark is not None:
                    spark.sparkContext.addJobTag(tag)
                with scope.in_limit(expired):
                    out.append((True, run()))
            except BaseException as e:
                out.append((False, e))
            finally:
                done.set()

        threading.Thread(target=contextvars.copy_context().run, args=(work,), daemon=True).start()
        if not done.wait(self.timeout):
            expired.set()
            if spark is not None:
                spark.sparkContext.cancelJobsWithTag(tag)
            raise TaskTimeout(f"{name} ran longer than {self.timeout} s")
        ok, value = out[0]
        if not ok:
            raise value
        return value

    def _materialised(self, value: Any, key: str | None, store: Any, metadata: scope.TaskMetadata) -> Any:
        """Inside an attempt: what must be written is written, and read again from there."""
        if not scope.still_wanted():
            raise TaskTimeout(f"{metadata.name} ran longer than {self.timeout} s")
        if key is not None and store is not None:
            value = store.put(key, value, self.cache_ttl)
        elif isinstance(value, DataFrame) and (self.retries or self.timeout is not None):
            value = value.persist()
            if state := scope.current_session():
                state.held.append(value)
            value.count()
        if self.dataset and scope.still_wanted():
            values = {**metadata.inputs, **({"map_index": metadata.map_index} if metadata.map_index is not None else {})}
            from taskloom.operators.compose import save_dataset

            save_dataset(resolve(self.dataset, values), value, format=self.dataset_format, store=self.dataset_store)
        return value

    def _steps(self, args: tuple, kwargs: dict) -> Iterator[Callable[[], Any] | None]:
        """The protocol of a call: yields what to run, is sent (error, value), returns the result."""
        metadata, hooks = self.metadata(args, kwargs), scope.hooks()
        key, store = self._key(metadata), scope.cache_store(self.cache_store) if self.cache else None
        with scope.in_task(metadata, self.dataset_store):
            if key is not None and store is not None and (hit := store.get(key)) is not MISS:
                hooks.call("on_cache_hit", metadata=metadata, key=key, value=hit)
                return hit
            hooks.call("before_node_execute", metadata=metadata)
        began, error = time.perf_counter(), None
        for attempt in range(self.retries + 1):
            if attempt:
                hooks.call("before_node_retry", metadata=metadata, attempt=attempt, error=error)
            error, value = yield metadata, key, store
            if attempt:
                hooks.call("after_node_retry", metadata=metadata, attempt=attempt, succeeded=error is None)
            if error is None:
                hooks.call("after_node_execute", metadata=metadata, result=value, duration=time.perf_counter() - began)
                return value
        hooks.call("on_node_error", metadata=metadata, error=error, duration=time.perf_counter() - began)
        tries = f" after {self.retries + 1} attempts" if self.retries else ""
        kind = TaskTimeout if isinstance(error, TaskTimeout) else TaskError
        raise kind(f"Task '{metadata.name}' failed{tries} with error: {_reason(error)}") from error

    def _run(self, args: tuple, kwargs: dict) -> Any:
        steps = self._steps(args, kwargs)
        send: Any = None
        while True:
            try:
                metadata, key, store = steps.send(send)
            except StopIteration as e:
                return e.value

            def attempt(metadata=metadata, key=key, store=store) -> Any:
                with scope.in_task(metadata, self.dataset_store):
                    return self._materialised(self.func(*args, **kwargs), key, store, metadata)

            try:
                send = (None, self._limited(attempt, metadata.name))
            except Exception as e:
                send = (e, None)

    async def _arun(self, args: tuple, kwargs: dict) -> Any:
        steps = self._steps(args, kwargs)
        send: Any = None
        while True:
            try:
                metadata, key, store = steps.send(send)
            except StopIteration as e:
                return e.value
            try:
                with scope.in_task(metadata, self.dataset_store):
                    value = await asyncio.wait_for(self.func(*args, **kwargs), self.timeout)
                    send = (None, self._materialised(value, key, store, metadata))
            except asyncio.TimeoutError:
                send = (TaskTimeout(f"{metadata.name} ran longer than {self.timeout} s"), None)
            except Exception as e:
                send = (e, None)

    def _stream(self, args: tuple, kwargs: dict) -> Iterator[Any]:
        metadata, hooks, began = self.metadata(args, kwargs), scope.hooks(), time.perf_counter()
        with scope.in_task(metadata, self.dataset_store):
            hooks.call("before_node_execute", metadata=metadata)
            source = self.func(*args, **kwargs)
        index = 0
        try:
            while True:
                # The task stands around the function only, not around what its reader does between two items.
                with scope.in_task(metadata, self.dataset_store):
                    try:
                        item = next(source)
                    except StopIteration:
                        break
                hooks.call("node_iteration", metadata=metadata, index=index)
                index += 1
                yield item
        except Exception as e:
            hooks.call("on_node_error", metadata=metadata, error=e, duration=time.perf_counter() - began)
            raise TaskError(f"Task '{metadata.name}' failed with error: {_reason(e)}") from e
        hooks.call("after_node_execute", metadata=metadata, result=None, duration=time.perf_counter() - began)

    async def _astream(self, args: tuple, kwargs: dict) -> AsyncIterator[Any]:
        metadata, hooks, began = self.metadata(args, kwargs), scope.hooks(), time.perf_counter()
        hooks.call("before_node_execute", metadata=metadata)
        index = 0
        try:
            async for item in self.func(*args, **kwargs):
                hooks.call("node_iteration", metadata=metadata, index=index)
                index += 1
                yield item
        except Exception as e:
            hooks.call("on_node_error", metadata=metadata, error=e, duration=time.perf_counter() - began)
            raise TaskError(f"Task '{metadata.name}' failed with error: {_reason(e)}") from e
        hooks.call("after_node_execute", metadata=metadata, result=None, duration=time.perf_counter() - began)

    def __call__(self, *args: Any, **kwargs: Any) -> Any:
        if any(isinstance(v, Column) for v in (*args, *kwargs.values())):
            return self.column(*args, **kwargs)
        if self.is_generator:
            return (self._astream if self.is_async else self._stream)(args, kwargs)
        return self._arun(args, kwargs) if self.is_async else self._run(args, kwargs)


def task(func: Callable | None = None, **options: Any) -> Any:
    """Makes a function a task, bare or with the options of ``Task``."""
    return (lambda f: Task(f, **options)) if func is None else Task(func, **options)
