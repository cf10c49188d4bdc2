"""Sessions: strategy, stores, plugins and a job tag for the work inside."""

from __future__ import annotations

import contextlib
import time
from collections.abc import AsyncIterator, Iterator
from typing import Any

from pyspark.sql import SparkSession

from taskloom import scope
from taskloom.plans.backends import Backends
from taskloom.plans.hooks import global_hooks, quiet
from taskloom.settings import Settings, get_global_settings


@contextlib.contextmanager
def session(
    *, backend: str | None = None, cache_store: Any = None, dataset_store: Any = None, plugins: tuple[Any, ...] | list[Any] = (), settings: Settings | None = None
) -> Iterator[scope.SessionState]:
    """Opens a session; what isn't given comes from an outer session, then from the settings.

    ``cache_store="off"`` turns caching off. Spark jobs inside carry the
    session's tag, and any still running at its end are cancelled.
    """
    outer = scope.current_session()
    state = scope.SessionState(
        id=scope.new_id(),
        settings=settings or (outer.settings if outer else get_global_settings()),
        hooks=(outer.hooks if outer else global_hooks()).extended(tuple(plugins)),
        backends=outer.backends if outer else Backends(),
        backend=backend or (outer.backend if outer else None),
        cache_store=cache_store or (outer.cache_store if outer else None),
        dataset_store=dataset_store or (outer.dataset_store if outer else None),
    )
    if state.backend:
        state.backends.get(state.backend)
    spark, tag = SparkSession.getActiveSession(), f"taskloom-{state.id}"
    began = time.perf_counter()
    with scope.in_session(state):
        if spark is not None:
            spark.sparkContext.addJobTag(tag)
        state.hooks.call("before_session_start", session_id=state.id)
        try:
            yield state
        finally:
            with quiet():
                state.hooks.call("after_session_end", session_id=state.id, duration=time.perf_counter() - began)
            for frame in state.held:
                # What still reads it afterwards computes it again.
                with quiet():
                    frame.unpersist()
            if spark is not None:
                with quiet():
                    spark.sparkContext.cancelJobsWithTag(tag)
                    spark.sparkContext.removeJobTag(tag)


@contextlib.asynccontextmanager
async def async_session(**options: Any) -> AsyncIterator[scope.SessionState]:
    """``session`` for ``async with``."""
    with session(**options) as state:
        yield state
