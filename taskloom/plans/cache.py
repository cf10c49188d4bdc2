"""Results by key, with safe keys for values and for DataFrames, and expiry.

A key depends on the task's source and on what its arguments are. For a
DataFrame that is its plan, schema, and the files it reads with their sizes and
times; where that would not tell two results apart, there is no key.
"""

from __future__ import annotations

import hashlib
import inspect
import json
import pickle
import re
import time
import uuid
from collections.abc import Callable, Mapping
from typing import Any

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taskloom.errors import Uncacheable
from taskloom.sources.storage import Storage

_VERSION = "1"


class _Miss:
    """What a lookup without result returns; false, and unlike a cached None."""

    def __bool__(self) -> bool:
        return False

    def __repr__(self) -> str:
        return "MISS"


MISS = _Miss()


def _canonical(value: Any) -> Any:
    """Containers in an order of their own, tagged by kind, so that equal ones pickle alike and unlike kinds don't."""
    if isinstance(value, DataFrame):
        return ("frame", frame_key(value))
    if isinstance(value, Mapping):
        return ("map", sorted(((repr(k), _canonical(v)) for k, v in value.items()), key=lambda kv: kv[0]))
    if isinstance(value, (set, frozenset)):
        return ("set", sorted(cloudpickle.dumps(_canonical(v)) for v in value))
    if isinstance(value, (list, tuple)):
        return (type(value).__name__, [_canonical(v) for v in value])
    return value


def _source(func: Callable) -> str:
    try:
        return inspect.getsource(func)
    except (OSError, TypeError):
        return cloudpickle.dumps(func).hex()


def value_key(func: Callable, arguments: Mapping[str, Any]) -> str:
    """The default key: the function's source and its arguments by name."""
    digest = hashlib.sha256(f"{_VERSION}\0{_source(func)}".encode())
    for name in sorted(arguments):
        digest.update(name.encode() + b"\0" + cloudpickle.dumps(_canonical(arguments[name])))
    return digest.hexdigest()


def _leaves(plan: Any) -> list[Any]:
    children = plan.children()
    if children.isEmpty():
        return [plan]
    return [leaf for i in range(children.size()) for leaf in _leaves(children.apply(i))]


def _has_python(plan: Any) -> bool:
    """Whether any expression of a plan is a Python function."""

    def inside(expression: Any) -> bool:
        if expression.getClass().getSimpleName().startswith("PythonUD"):
            return True
        return any(inside(expression.children().apply(i)) for i in range(expression.children().size()))

    own = plan.expressions()
    if any(inside(own.apply(i)) for i in range(own.size())):
        return True
    return any(_has_python(plan.children().apply(i)) for i in range(plan.children().size()))


def frame_key(df: DataFrame) -> str:
    """A key of what a DataFrame computes; Uncacheable where its plan can't tell.

    Plans over anything but files, with Python functions (their plans show
    names, not code), or with results that change from run to run have none.
    """
    spark = df.sparkSession
    analyzed = df._jdf.queryExecution().analyzed()
    kinds = {leaf.getClass().getSimpleName() for leaf in _leaves(analyzed)}
    if not kinds <= {"LogicalRelation", "HiveTableRelation"}:
        raise Uncacheable(f"the plan reads {', '.join(sorted(kinds))}, not only files")
    if not analyzed.deterministic():
        raise Uncacheable("the plan gives another result on each run")
    # Long lists of fields are cut in plan texts unless this says otherwise.
    limit = "spark.sql.debug.maxToStringFields"
    before = spark.conf.get(limit)
    spark.conf.set(limit, str(1 << 20))
    try:
        text, tree = analyzed.canonicalized().toString(), analyzed.treeString()
    finally:
        spark.conf.set(limit, before)
    if _has_python(analyzed) or re.search(r"(Map|FlatMap|CoGroup)\w*In(Pandas|Arrow)|PythonUDTF", tree):
        raise Uncacheable("the plan has Python functions, whose code it doesn't show")
    files = _files(spark, analyzed)
    return hashlib.sha256(repr((_VERSION, text, df.schema.json(), files)).encode()).hexdigest()


def _files(spark: SparkSession, plan: Any) -> tuple:
    """A digest of the names, sizes and times of all files below a plan's tables; executors list and hash them."""
    roots = set()
    for leaf in _leaves(plan):
        try:
            paths = leaf.relation().location().rootPaths() if leaf.getClass().getSimpleName() == "LogicalRelation" else leaf.tableMeta().location()
        except Exception as e:
            raise Uncacheable("the plan reads no files") from e
        roots |= {str(paths.apply(i)) for i in range(paths.size())} if hasattr(paths, "size") else {str(paths)}
    if not roots:
        raise Uncacheable("the plan reads no files")
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(sorted(roots)).select("path", "length", "modificationTime")
    hashes = [F.xxhash64(F.lit(seed), "path", "length", "modificationTime") for seed in (1, 2)]
    found = listed.agg(F.count(F.lit(1)), F.bit_xor(hashes[0]), F.sum(hashes[1].cast("decimal(38,0)"))).first()
    return (sorted(roots), *[str(v) for v in found])


class CacheStore:
    """Results below a base path, in folders by the first two digits of the key.

    The data are written first, under a name of their own, and the sidecar
    that names them is moved into place last: until then the entry before is
    whole, and its data go only afterwards. DataFrames are kept as Parquet, other values pickled.
    """

    def __init__(self, base: str | Storage = ".cache", clock: Callable[[], float] = time.time):
        self.storage = base if isinstance(base, Storage) else Storage(base)
        self.clock = clock

    @staticmethod
    def _place(key: str) -> str:
        if not re.fullmatch(r"[0-9a-fA-F]{3,}", key):
            raise ValueError(f"a cache key is at least three hexadecimal digits, not {key!r}")
        return f"{key[:2]}/{key[2:]}"

    def _meta(self, at: str) -> dict | None:
        try:
            meta = json.loads(self.storage.load(f"{at}.meta.json"))
            return meta if {"timestamp", "ttl", "kind", "data"} <= set(meta) else None
        except (KeyError, ValueError, OSError, TypeError):
            return None

    def get(self, key: str) -> Any:
        """The value, or MISS if it is absent, expired or unreadable."""
        meta = self._meta(self._place(key))
        if meta is None:
            return MISS
        if meta["ttl"] is not None and self.clock() - meta["timestamp"] > meta["ttl"]:
            self.invalidate(key)
            return MISS
        try:
            if meta["kind"] == "frame":
                spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
                return spark.read.parquet(self.storage.path(meta["data"]))
            return pickle.loads(self.storage.load(meta["data"]))
        except (KeyError, OSError, EOFError, pickle.UnpicklingError):
            return MISS
        except Exception as e:
            if meta["kind"] == "frame":
                return MISS
            raise e

    def put(self, key: str, value: Any, ttl: int | None = None) -> Any:
        """Keeps a value and returns it; of a DataFrame, the written one."""
        at, frame = self._place(key), isinstance(value, DataFrame)
        before = self._meta(at)
        data = f"{at}.{uuid.uuid4().hex[:8]}.{'parquet' if frame else 'pkl'}"
        if frame:
            path = self.storage.path(data)
            try:
                value.write.mode("errorifexists").parquet(path)
            except Exception:
                self.storage.delete(data)
                raise
            value = value.sparkSession.read.schema(value.schema).parquet(path)
        else:
            self.storage.save(data, cloudpickle.dumps(value))
        meta = {"timestamp": self.clock(), "ttl": ttl, "kind": "frame" if frame else "value", "data": data, "schema": value.schema.json() if frame else None}
        self.storage.save(f"{at}.meta.json", json.dumps(meta).encode())
        if before:
            self.storage.delete(before["data"])
        return value

    def invalidate(self, key: str) -> None:
        at = self._place(key)
        meta = self._meta(at)
        self.storage.delete(f"{at}.meta.json")
        if meta:
            self.storage.delete(meta["data"])

    def keys(self) -> list[str]:
        """Keys of all entries, expired ones included."""
        found = (re.fullmatch(r"([0-9a-fA-F]{2})/([0-9a-fA-F]+)\.meta\.json", k) for k in self.storage.list_keys())
        return sorted(m[1] + m[2] for m in found if m)

    def clear(self) -> None:
        """Deletes all entries, and nothing else that lies there."""
        for key in self.storage.list_keys():
            if re.fullmatch(r"[0-9a-fA-F]{2}/[0-9a-fA-F]+\.(meta\.json|[0-9a-f]{8}\.(pkl|parquet))", key):
                self.storage.delete(key)
