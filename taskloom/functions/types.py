"""From Python annotations to Spark types, and from command line text to values."""

from __future__ import annotations

import collections.abc
import dataclasses
import datetime
import decimal
import types
import typing
from typing import Any

from pyspark.sql import types as T

_PLAIN: dict[Any, T.DataType] = {
    bool: T.BooleanType(),
    int: T.LongType(),
    float: T.DoubleType(),
    str: T.StringType(),
    bytes: T.BinaryType(),
    decimal.Decimal: T.DecimalType(38, 18),
    datetime.datetime: T.TimestampType(),
    datetime.date: T.DateType(),
    datetime.timedelta: T.DayTimeIntervalType(),
}
_MANY = (list, set, frozenset, collections.abc.Iterator, collections.abc.AsyncIterator, collections.abc.Iterable, collections.abc.Sequence, collections.abc.Generator)


def spark_type(annotation: Any) -> T.DataType:
    """The Spark type of an annotation; TypeError for one that has none."""
    if annotation in _PLAIN:
        return _PLAIN[annotation]
    origin, args = typing.get_origin(annotation), typing.get_args(annotation)
    if origin in (typing.Union, types.UnionType):
        inner = [a for a in args if a is not type(None)]
        if len(inner) == 1:
            return spark_type(inner[0])
    elif origin in _MANY and args:
        return T.ArrayType(spark_type(args[0]))
    elif origin in (dict, collections.abc.Mapping) and len(args) == 2:
        return T.MapType(spark_type(args[0]), spark_type(args[1]))
    elif origin is tuple and args and Ellipsis not in args:
        return T.StructType([T.StructField(f"_{i}", spark_type(a)) for i, a in enumerate(args, 1)])
    elif dataclasses.is_dataclass(annotation) or typing.is_typeddict(annotation):
        return T.StructType([T.StructField(n, spark_type(a)) for n, a in typing.get_type_hints(annotation).items()])
    raise TypeError(f"no Spark type for {annotation!r}")


def coerce(text: str, annotation: Any) -> Any:
    """A command line value in the type of its parameter; untyped ones stay text."""
    args = typing.get_args(annotation)
    if typing.get_origin(annotation) in (typing.Union, types.UnionType):
        if type(None) in args and text.lower() in ("none", "null"):
            return None
        annotation = next((a for a in args if a is not type(None)), str)
    if annotation is bool:
        return text.strip().lower() in ("true", "1", "yes", "y")
    return annotation(text) if annotation in (int, float, decimal.Decimal) else text
