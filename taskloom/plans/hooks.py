"""Lifecycle hooks, events by type, and the event rows that a session gathers."""

from __future__ import annotations

import contextlib
import dataclasses
import datetime
import logging
import logging.config
import threading
from collections.abc import Callable, Hashable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from taskloom.functions.formatting import format_duration
from taskloom.scope import TaskMetadata, current_session, current_task, settings

log = logging.getLogger("taskloom")

# The names of the hooks, in the order of a run.
HOOKS = (
    "before_session_start",
    "before_node_execute",
    "on_cache_hit",
    "before_node_retry",
    "after_node_retry",
    "node_iteration",
    "on_node_error",
    "after_node_execute",
    "before_dataset_save",
    "after_dataset_save",
    "before_dataset_load",
    "after_dataset_load",
    "after_session_end",
)

EVENT_SCHEMA = (
    "session_id string, task_id string, parent_id string, name string, map_index long, "
    "event string, attempt int, duration double, ts timestamp, data map<string,string>"
)


@contextlib.contextmanager
def quiet(said: str = "while ending a session"):
    """Errors inside are logged and go no further."""
    try:
        yield
    except Exception:
        log.exception(said)


class EventRegistry:
    """Who is to hear of which events, as (event type, handler) in the order of their coming.

    A subclass says in ``deliver`` what becomes of an event; here all its
    handlers get it, and what one of them raises is logged and held back.
    """

    def __init__(self) -> None:
        self.subscribers: list[tuple[Hashable, Callable[[dict], None]]] = []

    def register(self, kind: Hashable, handler: Callable[[dict], None]) -> None:
        self.subscribers.append((kind, handler))

    def deliver(self, kind: Hashable, data: dict) -> None:
        for wanted, handler in self.subscribers:
            if wanted == kind:
                with quiet(f"a handler of event {kind!r} failed"):
                    handler(data)

    def dispatch(self, kind: Hashable, data: dict) -> None:
        self.deliver(kind, data)


class Hooks:
    """Plugins called by hook name, in the order of their registration.

    A plugin is any object with methods named as hooks; it takes the keyword
    arguments it names. ``register_event_handlers(registry)`` is called once.
    A hook that raises stops the call it belongs to.
    """

    def __init__(self, plugins: tuple[Any, ...] = ()):
        self.plugins: list[Any] = []
        self.events = EventRegistry()
        for p in plugins:
            self.register(p)

    def register(self, plugin: Any) -> None:
        if isinstance(plugin, type):
            raise TypeError(f"register an instance of {plugin.__name__}, not the class")
        if not any(hasattr(plugin, h) for h in (*HOOKS, "register_event_handlers")):
            raise TypeError(f"{plugin!r} has no hook")
        if any(p is plugin for p in self.plugins):
            return
        self.plugins.append(plugin)
        if hasattr(plugin, "register_event_handlers"):
            plugin.register_event_handlers(self.events)

    def has(self, plugin: Any) -> bool:
        return any(p is plugin for p in self.plugins)

    def call(self, hook: str, **values: Any) -> None:
        if settings().trace_hooks:
            log.info("hook %s: %s", hook, ", ".join(f"{k}={v!r}" for k, v in values.items()))
        for p in self.plugins:
            if (method := getattr(p, hook, None)) is None:
                continue
            code = getattr(method, "__code__", None)
            takes_all = code is None or code.co_flags & 0x08
            method(**(values if takes_all else {k: v for k, v in values.items() if k in code.co_varnames[: code.co_argcount + code.co_kwonlyargcount]}))

    def extended(self, plugins: tuple[Any, ...]) -> Hooks:
        return Hooks((*self.plugins, *plugins))


_global = Hooks()


def global_hooks() -> Hooks:
    return _global


def register_plugins(*plugins: Any) -> None:
    """Plugins of all sessions, and of tasks outside of one."""
    for p in plugins:
        _global.register(p)


def has_plugin(plugin: Any) -> bool:
    return _global.has(plugin)


def reset_plugins() -> None:
    global _global
    _global = Hooks()


class EventLog:
    """A plugin that keeps a row for each hook call, to be read as a DataFrame."""

    def __init__(self) -> None:
        self._rows: list[tuple] = []
        self._lock = threading.Lock()

    def _add(self, event: str, metadata: TaskMetadata | None = None, session_id: str | None = None, attempt: int | None = None, duration: float | None = None, **data: Any) -> None:
        state = current_session()
        row = (
            session_id or (state.id if state else None), metadata.id if metadata else None, metadata.parent_id if metadata else None, metadata.name if metadata else None,
            metadata.map_index if metadata else None, event, attempt, duration, datetime.datetime.now(datetime.timezone.utc), {k: str(v) for k, v in data.items() if v is not None},
        )
        with self._lock:
            self._rows.append(row)

    def rows(self) -> list[tuple]:
        with self._lock:
            return list(self._rows)

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows(), EVENT_SCHEMA)


def _recorder(hook: str) -> Callable[..., None]:
    def record(self: EventLog, **values: Any) -> None:
        values.pop("result", None)
        values.pop("value", None)
        self._add(hook, **values)

    record.__name__ = hook
    return record


for _hook in HOOKS:
    setattr(EventLog, _hook, _recorder(_hook))


def configure_logging(level: str = "INFO", path: str | None = None) -> None:
    """The engine's default logging: lines with time, level and logger, to standard error or appended to a file."""
    target = {"class": "logging.FileHandler", "filename": path} if path else {"class": "logging.StreamHandler"}
    logging.config.dictConfig(
        {
            "version": 1,
            "disable_existing_loggers": False,
            "formatters": {"line": {"format": "%(asctime)s %(levelname)-7s %(name)s: %(message)s"}},
            "handlers": {"taskloom": {**target, "formatter": "line"}},
            "loggers": {"taskloom": {"handlers": ["taskloom"], "level": level, "propagate": False}},
        }
    )


@dataclasses.dataclass
class LifecycleLog:
    """A plugin that logs sessions and tasks as they begin, end and fail."""

    level: int = logging.INFO

    def before_session_start(self, session_id: str) -> None:
        log.log(self.level, "session %s begins", session_id)

    def after_session_end(self, session_id: str, duration: float) -> None:
        log.log(self.level, "session %s ended after %s", session_id, format_duration(duration))

    def before_node_execute(self, metadata: TaskMetadata) -> None:
        log.log(self.level, "%s begins", metadata.name)

    def after_node_execute(self, metadata: TaskMetadata, duration: float) -> None:
        log.log(self.level, "%s ended after %s", metadata.name, format_duration(duration))

    def before_node_retry(self, metadata: TaskMetadata, attempt: int, error: Exception) -> None:
        log.log(self.level, "%s: attempt %d after %s", metadata.name, attempt, error)

    def on_cache_hit(self, metadata: TaskMetadata) -> None:
        log.log(self.level, "%s: found in the cache", metadata.name)

    def on_node_error(self, metadata: TaskMetadata, error: Exception, duration: float) -> None:
        log.error("%s failed after %s: %s", metadata.name, format_duration(duration), error)


class _TaskLogger(logging.LoggerAdapter):
    def process(self, msg: Any, kwargs: Any) -> tuple[Any, Any]:
        if task := current_task():
            kwargs["extra"] = {**kwargs.get("extra", {}), "task_id": task.id, "task_name": task.name}
            msg = f"[{task.name}] {msg}"
        return msg, kwargs


def get_logger(name: str = "taskloom") -> logging.LoggerAdapter:
    """A logger whose records name the task under way."""
    return _TaskLogger(logging.getLogger(name), {})


class Outbox(EventRegistry):
    """On an executor: events wait here and go back to the driver with the results."""

    def __init__(self) -> None:
        super().__init__()
        self.waiting: list[tuple[Hashable, dict]] = []

    def deliver(self, kind: Hashable, data: dict) -> None:
        self.waiting.append((kind, data))

    def taken(self) -> list[tuple[Hashable, dict]]:
        out = self.waiting
        self.waiting = []
        return out


def emit(kind: Hashable, **data: Any) -> None:
    """Sends an event to the handlers of the current session's plugins; from an executor, with the results."""
    from taskloom.scope import hooks

    hooks().events.dispatch(kind, data)


def portable(plugins: list[Any]) -> list[tuple[type, dict]]:
    """Plugins that executors can have: those with ``to_config`` and ``from_config``."""
    return [(type(p), p.to_config()) for p in plugins if hasattr(p, "to_config") and hasattr(p, "from_config")]


def rebuilt(configs: list[tuple[type, dict]]) -> Hooks:
    """Hooks of an executor, whose events go to an outbox."""
    found = Hooks()
    found.events = Outbox()
    found.plugins = [kind.from_config(config) for kind, config in configs]
    return found


class _Forward(logging.Handler):
    """On an executor: sends log records as events."""

    def emit(self, record: logging.LogRecord) -> None:
        emit("log", name=record.name, level=record.levelno, message=record.getMessage())


@contextlib.contextmanager
def forwarded_logs():
    """Records of the engine's loggers go to the driver while this is open."""
    handler, before = _Forward(), log.level
    log.addHandler(handler)
    log.setLevel(logging.DEBUG)
    try:
        yield
    finally:
        log.removeHandler(handler)
        log.setLevel(before)


@dataclasses.dataclass
class CentralLog:
    """A plugin that logs on the driver what tasks on executors have logged, from a level on."""

    level: int = logging.INFO

    def register_event_handlers(self, registry: EventRegistry) -> None:
        registry.register("log", self._write)

    def _write(self, data: dict) -> None:
        if data["level"] >= self.level:
            logging.getLogger(data["name"]).log(data["level"], "%s", data["message"])
