"""Datasets: values and DataFrames by key, in formats told by type and extension."""

from __future__ import annotations

import dataclasses
import importlib.metadata
import logging
import pickle
from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from taskloom.errors import DatasetError
from taskloom.functions.templates import resolve
from taskloom.sources.storage import Storage


@dataclasses.dataclass(frozen=True)
class ValueFormat:
    """How values of a type become bytes; options go to both functions."""

    kind: type
    name: str
    extensions: tuple[str, ...]
    write: Callable[..., bytes]
    read: Callable[..., Any]
    trusted: bool = True


@dataclasses.dataclass(frozen=True)
class FrameFormat:
    """A Spark source by extension; options go to the reader and the writer."""

    name: str
    extensions: tuple[str, ...]
    read_options: Mapping[str, str] = dataclasses.field(default_factory=dict)
    write_options: Mapping[str, str] = dataclasses.field(default_factory=dict)


_values: dict[tuple[type, str], ValueFormat] = {}
_frames: dict[str, FrameFormat] = {}


def register(fmt: ValueFormat | FrameFormat) -> None:
    """Adds a format; the last one for a type and a name stands."""
    if isinstance(fmt, FrameFormat):
        _frames[fmt.name] = fmt
        return
    if not isinstance(fmt.kind, type) or not fmt.name:
        raise DatasetError("a value format needs a type and a name")
    _values[(fmt.kind, fmt.name)] = fmt


def _unpickle(data: bytes, **options: Any) -> Any:
    return pickle.loads(data, **{k: v for k, v in options.items() if k == "encoding"})


def _pickle(value: Any, **options: Any) -> bytes:
    return pickle.dumps(value, **{k: v for k, v in options.items() if k == "protocol"})


register(ValueFormat(str, "text", ("txt",), lambda v, **o: v.encode(o.get("encoding", "utf-8")), lambda b, **o: b.decode(o.get("encoding", "utf-8"))))
register(ValueFormat(bytes, "raw", ("bin",), lambda v, **o: v, lambda b, **o: b))
for _kind in (object, dict, list, tuple, set, frozenset):
    register(ValueFormat(_kind, "pickle", ("pkl", "pickle"), _pickle, _unpickle, trusted=False))
for _name, _options in (("parquet", {}), ("orc", {}), ("json", {}), ("csv", {"header": "true"}), ("text", {}), ("binaryFile", {})):
    register(FrameFormat(_name, (_name,), _options, _options))


def load_plugins(group: str = "taskloom.datasets") -> list[str]:
    """Registers the formats that installed packages offer: entry points of a format or a function that gives some."""
    loaded = []
    for point in importlib.metadata.entry_points(group=group):
        try:
            found = point.load()
            found = found() if callable(found) else found
            for fmt in found if isinstance(found, (list, tuple)) else [found]:
                register(fmt)
            loaded.append(point.name)
        except Exception:
            logging.getLogger("taskloom").exception("dataset plugin %s can't be loaded", point.name)
    return loaded


def formats_for(kind: type) -> list[str]:
    """Names of the formats of a type, its bases' included."""
    return sorted({f.name for f in _values.values() if issubclass(kind, f.kind)})


def value_format(kind: type, name: str) -> ValueFormat:
    """The type's own format of that name, or that of its nearest base."""
    for base in kind.__mro__:
        if (base, name) in _values:
            return _values[(base, name)]
    raise ValueError(f"no format {name!r} for {kind.__name__}; available: {', '.join(formats_for(kind)) or 'none'}")


def infer_format(kind: type, hint: str | None = None) -> str:
    """By extension, else the first format of the nearest type that has one."""
    for base in kind.__mro__:
        own = [f for (k, _), f in _values.items() if k is base]
        for f in own:
            if hint in f.extensions:
                return f.name
    for base in kind.__mro__:
        for (k, _), f in _values.items():
            if k is base:
                return f.name
    raise ValueError(f"no format for {kind.__name__}")


def extension_of(kind: type, name: str) -> str:
    return value_format(kind, name).extensions[0]


def _frame_format(hint: str | None, name: str | None) -> FrameFormat:
    if name:
        return _frames.get(name) or FrameFormat(name, ())
    return next((f for f in _frames.values() if hint in f.extensions), _frames["parquet"])


class DatasetStore:
    """Datasets below a base path. Keys may be templates, filled in by the current task's inputs.

    A DataFrame becomes a folder of files of a Spark source, written by the
    executors; any other value one file. Pickled files hold code: they are
    read only by a store made with ``trust_pickle``.
    """

    def __init__(self, base: str | Storage = ".", trust_pickle: bool = False, outside: bool = False):
        self.storage = base if isinstance(base, Storage) else Storage(base, outside)
        self.trust_pickle = trust_pickle

    @property
    def base_path(self) -> str:
        return self.storage.base

    @staticmethod
    def _key(key: str) -> str:
        from taskloom.scope import current_inputs

        inputs = current_inputs()
        return resolve(key, inputs) if inputs else key

    def save(self, key: str, value: Any, format: str | None = None, options: Mapping[str, Any] | None = None, partition_by: tuple[str, ...] = ()) -> str:
        """Writes a value and returns its full path."""
        key, options = self._key(key), dict(options or {})
        hint = Storage.format_hint(key)
        if isinstance(value, DataFrame):
            fmt = _frame_format(hint, format)
            writer = value.write.mode(options.pop("mode", "overwrite")).format(fmt.name).options(**{**fmt.write_options, **options})
            (writer.partitionBy(*partition_by) if partition_by else writer).save(self.storage.path(key))
            return self.storage.path(key)
        fmt = value_format(type(value), format or infer_format(type(value), hint))
        return self.storage.save(key, fmt.write(value, **options))

    def load(self, key: str, kind: type | None = None, format: str | None = None, options: Mapping[str, Any] | None = None, schema: Any = None) -> Any:
        """Reads a value of a type, or a DataFrame; KeyError for a missing key.

        Without a type the extension tells it: text, raw bytes, or a Spark
        source; pickles need ``trust_pickle``.
        """
        key, options = self._key(key), dict(options or {})
        if not self.storage.exists(key):
            raise KeyError(key)
        hint = Storage.format_hint(key)
        if kind is None and format is None:
            kind = {"txt": str, "bin": bytes, "pkl": object, "pickle": object}.get(hint or "", DataFrame)
        if kind is None:
            kind = DataFrame if format in _frames and format != "text" else {"text": str, "raw": bytes}.get(format or "", object)
        if kind is DataFrame:
            spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
            fmt = _frame_format(hint, format)
            reader = spark.read.format(fmt.name).options(**{**fmt.read_options, **options})
            return (reader.schema(schema) if schema is not None else reader).load(self.storage.path(key))
        fmt = value_format(kind, format or infer_format(kind, hint))
        if not fmt.trusted and not self.trust_pickle:
            raise ValueError(f"{key!r} is pickled; make the store with trust_pickle=True to read it")
        return fmt.read(self.storage.load(key), **options)

    def exists(self, key: str) -> bool:
        return self.storage.exists(self._key(key))

    def delete(self, key: str) -> None:
        self.storage.delete(self._key(key))

    def list_keys(self) -> list[str]:
        return self.storage.list_keys()
