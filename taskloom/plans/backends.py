"""Execution strategies of a map: in place, by threads, or as one Spark job."""

from __future__ import annotations

import contextlib
import contextvars
import dataclasses
import pickle
import threading
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Any

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import SparkSession

from taskloom.errors import BackendError
from taskloom.plans.hooks import forwarded_logs, portable, rebuilt
from taskloom.scope import SessionState, at_index, current_session, current_task, hooks, in_session, in_task, settings

#: A strategy takes a function and the argument tuples, and gives (error, result) for each, in order.
Strategy = Callable[[Callable, list[tuple]], list[tuple[BaseException | None, Any]]]


def _call(func: Callable, index: int, args: tuple) -> tuple[BaseException | None, Any]:
    with at_index(index):
        try:
            return None, func(*args)
        except Exception as e:
            return e, None


def inline(func: Callable, calls: list[tuple]) -> list[tuple[BaseException | None, Any]]:
    return [_call(func, i, args) for i, args in enumerate(calls)]


def threads(func: Callable, calls: list[tuple]) -> list[tuple[BaseException | None, Any]]:
    """A pool that may launch Spark actions; each call sees the caller's context."""
    with ThreadPoolExecutor(settings().max_backend_threads, "taskloom") as pool:
        waiting = [pool.submit(contextvars.copy_context().run, _call, func, i, args) for i, args in enumerate(calls)]
        return [w.result() for w in waiting]


def distributed(func: Callable, calls: list[tuple]) -> list[tuple[BaseException | None, Any]]:
    """One Spark job over all elements; results, errors and events come back with their index."""
    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    rows = [(i, bytearray(cloudpickle.dumps(args))) for i, args in enumerate(calls)]
    width = max(1, min(len(rows), settings().max_partitions or spark.sparkContext.defaultParallelism))

    state, inside, own = current_session(), current_task(), hooks()
    given = state.settings if state else settings()
    stores = (state.backend, state.cache_store, state.dataset_store) if state else ()
    plugins = portable(own.plugins)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there = rebuilt(plugins)
        with contextlib.ExitStack() as stack:
            stack.enter_context(in_session(SessionState("worker", given, there, Backends(), *stores)))
            stack.enter_context(forwarded_logs())
            if inside:
                stack.enter_context(in_task(dataclasses.replace(inside, inputs={})))
            for batch in batches:
                out = []
                for i, args in zip(batch.column("map_index").to_pylist(), batch.column("args").to_pylist(), strict=True):
                    error, result = _call(func, i, pickle.loads(args))
                    try:
                        blob = cloudpickle.dumps((error, result, there.events.taken()))
                    except Exception as e:
                        blob = cloudpickle.dumps((TypeError(f"the result can't be sent back: {e}"), None, []))
                    out.append(blob)
                yield pa.RecordBatch.from_arrays([batch.column("map_index"), pa.array(out, pa.binary())], names=["map_index", "blob"])

    frame = spark.createDataFrame(rows, "map_index long, args binary").repartitionByRange(width, "map_index")
    found = frame.mapInArrow(work, "map_index long, blob binary").collect()
    results = [pickle.loads(r["blob"]) for r in sorted(found, key=lambda r: r["map_index"])]
    for _, _, events in results:
        for kind, data in events:
            own.events.dispatch(kind, data)
    return [(error, value) for error, value, _ in results]


# Names that stand for the strategies.
_ALIASES = {
    "inline": "inline",
    "sequential": "inline",
    "synchronous": "inline",
    "thread": "thread",
    "threading": "thread",
    "threads": "thread",
    "process": "distributed",
    "processes": "distributed",
    "multiprocessing": "distributed",
    "distributed": "distributed",
    "spark": "distributed",
}


class Backends:
    """Strategies by name; aliases of one share it."""

    def __init__(self) -> None:
        self._strategies: dict[str, Strategy] = {"inline": inline, "thread": threads, "distributed": distributed}
        self._lock = threading.Lock()

    def register(self, name: str, strategy: Strategy) -> None:
        if not callable(strategy):
            raise TypeError("a strategy is a function")
        with self._lock:
            self._strategies[name] = strategy

    def get(self, name: str) -> Strategy:
        name = name if name in self._strategies else _ALIASES.get(name, name)
        if name not in self._strategies:
            raise BackendError(f"Unknown backend {name!r}; available: {', '.join(sorted({*_ALIASES, *self._strategies}))}")
        return self._strategies[name]


_global = Backends()


def active_backends() -> Backends:
    state = current_session()
    return state.backends if state else _global
