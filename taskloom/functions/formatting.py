"""Durations for people to read."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def format_duration(seconds: float) -> str:
    """Milliseconds below a second, seconds below a minute, minutes and seconds from there on."""
    if seconds < 1:
        return f"{1000 * seconds:.0f} ms"
    whole, rest = divmod(seconds, 60)
    return f"{int(whole)} min {rest:.2f} s" if whole else f"{seconds:.2f} s"


def duration_column(seconds: Column) -> Column:
    """Whole seconds below a minute, whole minutes from there on."""
    of = F.when(seconds < 60, seconds).otherwise(seconds / 60)
    return F.concat(F.floor(of).cast("string"), F.when(seconds < 60, F.lit(" s")).otherwise(F.lit(" min")))
