"""Templates with ``{name}`` placeholders, for text and for columns."""

from __future__ import annotations

import re
import string
from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def placeholders(template: str) -> frozenset[str]:
    """The names in a template; ValueError for unbalanced braces and for ``{}``."""
    try:
        names = [name for _, name, _, _ in string.Formatter().parse(template) if name is not None]
    except ValueError as e:
        raise ValueError(f"Invalid key template {template!r}: {e}") from e
    if "" in names:
        raise ValueError(f"Invalid key template {template!r}: empty placeholder")
    return frozenset(names)


class _Lenient(string.Formatter):
    def get_field(self, field_name: str, args: Any, kwargs: Any) -> Any:
        name = re.split(r"[.\[]", field_name, maxsplit=1)[0]
        if name not in kwargs:
            return _Literal(field_name), name
        return super().get_field(field_name, args, kwargs)


class _Literal(str):
    """A placeholder that stays as it is written."""

    def __format__(self, spec: str) -> str:
        return "{" + self + (f":{spec}" if spec else "") + "}"


def resolve(template: str, values: Mapping[str, Any]) -> str:
    """Fills in the placeholders that have values; others stay."""
    return _Lenient().vformat(template, (), dict(values))


def template_column(template: str, values: Mapping[str, Column]) -> Column:
    """The template filled in by columns, as one expression; null where a value is null."""
    parts: list[Column] = []
    for text, name, spec, _ in string.Formatter().parse(template):
        if text:
            parts.append(F.lit(text))
        if name is not None:
            literal = F.lit("{" + name + (f":{spec}" if spec else "") + "}")
            parts.append(values[name].cast("string") if name in values else literal)
    return F.concat(*parts) if parts else F.lit("")
