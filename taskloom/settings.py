"""Settings: defaults, environment, and ``spark.taskloom.*`` of a session's configuration."""

from __future__ import annotations

import dataclasses
import os
import threading

from pyspark.sql import SparkSession

#: Namespace of the settings in a Spark configuration.
PREFIX = "spark.taskloom."


def _flag(name: str) -> bool:
    return os.environ.get(name, "").strip().lower() in ("1", "true", "yes", "y")


@dataclasses.dataclass(frozen=True)
class Settings:
    backend: str = "inline"
    max_backend_threads: int = dataclasses.field(default_factory=lambda: min(32, (os.cpu_count() or 1) + 4))
    #: Parts of a map's Spark job at most; 0: as many as the cluster runs at once.
    max_partitions: int = 0
    #: Whether every hook call is logged.
    trace_hooks: bool = dataclasses.field(default_factory=lambda: _flag("TASKLOOM_TRACE_HOOKS"))
    dataset_store: str = dataclasses.field(default_factory=lambda: os.environ.get("TASKLOOM_DATASET_STORE", "."))
    cache_store: str = dataclasses.field(default_factory=lambda: os.environ.get("TASKLOOM_CACHE_STORE", ".cache"))

    def overridden(self, values: dict[str, str]) -> Settings:
        """With text values in the types of their fields; ValueError for a name that is none."""
        kinds = {f.name: type(getattr(self, f.name)) for f in dataclasses.fields(self)}
        if unknown := set(values) - set(kinds):
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        parsed = {k: v.lower() in ("1", "true", "yes", "y") if kinds[k] is bool else kinds[k](v) for k, v in values.items()}
        return dataclasses.replace(self, **parsed)

    @classmethod
    def of_session(cls, spark: SparkSession) -> Settings:
        found = {f.name: spark.conf.get(PREFIX + f.name, None) for f in dataclasses.fields(cls)}
        return cls().overridden({k: v for k, v in found.items() if v is not None})


_lock = threading.RLock()
_global: Settings | None = None


def get_global_settings() -> Settings:
    global _global
    with _lock:
        if _global is None:
            _global = Settings()
        return _global


def set_global_settings(settings: Settings | None) -> None:
    """None goes back to the defaults."""
    global _global
    with _lock:
        _global = settings
