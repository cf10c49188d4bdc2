"""Where a call stands: the session, the task under way, and the element of a map."""

from __future__ import annotations

import contextvars
import dataclasses
import threading
import uuid
from collections.abc import Mapping
from typing import TYPE_CHECKING, Any

from taskloom.settings import Settings, get_global_settings

if TYPE_CHECKING:
    from taskloom.plans.backends import Backends
    from taskloom.plans.cache import CacheStore
    from taskloom.plans.hooks import Hooks
    from taskloom.sources.datasets import DatasetStore


@dataclasses.dataclass(frozen=True)
class TaskMetadata:
    """What hooks and event rows know of an invocation."""

    id: str
    name: str
    backend: str
    inputs: Mapping[str, Any]
    description: str = ""
    map_index: int | None = None
    parent_id: str | None = None
    is_async: bool = False
    is_generator: bool = False


@dataclasses.dataclass
class SessionState:
    id: str
    settings: Settings
    hooks: Hooks
    backends: Backends
    backend: str | None = None
    cache_store: CacheStore | str | None = None
    dataset_store: DatasetStore | str | None = None
    #: DataFrames that tasks have persisted; freed as the session ends.
    held: list[Any] = dataclasses.field(default_factory=list)


_session: contextvars.ContextVar[SessionState | None] = contextvars.ContextVar("taskloom_session", default=None)
_task: contextvars.ContextVar[tuple[TaskMetadata, Any] | None] = contextvars.ContextVar("taskloom_task", default=None)
_limit: contextvars.ContextVar[threading.Event | None] = contextvars.ContextVar("taskloom_limit", default=None)
_index: contextvars.ContextVar[int | None] = contextvars.ContextVar("taskloom_index", default=None)


class _Within:
    """Sets a variable for a ``with`` block; once only, and blocks end in the order of their beginnings."""

    def __init__(self, var: contextvars.ContextVar, value: Any):
        self.var, self.value, self.token = var, value, None

    def __enter__(self) -> None:
        if self.token is not None:
            raise RuntimeError(f"this context of {self.var.name} was entered before")
        self.token = self.var.set(self.value)

    def __exit__(self, *error: Any) -> None:
        if self.token is None or self.token.var is not self.var or self.var.get() is not self.value:
            raise RuntimeError(f"contexts of {self.var.name} are left in another order than they were entered")
        self.var.reset(self.token)


def _set(var: contextvars.ContextVar, value: Any) -> _Within:
    return _Within(var, value)


def in_limit(expired: threading.Event) -> _Within:
    return _set(_limit, expired)


def still_wanted() -> bool:
    """Whether the call under way is within its time limit; after it, nothing is written."""
    expired = _limit.get()
    return expired is None or not expired.is_set()


def in_session(state: SessionState):
    return _set(_session, state)


def in_task(metadata: TaskMetadata, dataset_store: Any = None):
    return _set(_task, (metadata, dataset_store))


def at_index(index: int | None):
    return _set(_index, index)


def current_session() -> SessionState | None:
    return _session.get()


def current_task() -> TaskMetadata | None:
    found = _task.get()
    return found[0] if found else None


def current_inputs() -> Mapping[str, Any]:
    found = _task.get()
    return found[0].inputs if found else {}


def current_index() -> int | None:
    return _index.get()


def settings() -> Settings:
    state = _session.get()
    return state.settings if state else get_global_settings()


def backend_name(own: str | None = None) -> str:
    """The task's or call's own, else the session's, else that of the settings."""
    state = _session.get()
    return own or (state.backend if state else None) or settings().backend


def hooks() -> Hooks:
    from taskloom.plans.hooks import global_hooks

    state = _session.get()
    return state.hooks if state else global_hooks()


def cache_store(own: CacheStore | str | None = None) -> CacheStore | None:
    """The nearest cache store; None where the nearest setting is "off"."""
    from taskloom.plans.cache import CacheStore

    state = _session.get()
    found = own or (state.cache_store if state else None) or settings().cache_store
    if found == "off":
        return None
    return CacheStore(found) if isinstance(found, str) else found


def dataset_store(own: DatasetStore | str | None = None) -> DatasetStore:
    """Argument, then the enclosing task's, the session's, and that of the settings."""
    from taskloom.sources.datasets import DatasetStore

    state, task = _session.get(), _task.get()
    found = own or (task[1] if task else None) or (state.dataset_store if state else None) or settings().dataset_store
    return DatasetStore(found) if isinstance(found, str) else found


def new_id() -> str:
    return uuid.uuid4().hex
