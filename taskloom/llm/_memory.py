"""Python workers are kept between tasks: what a task has freed goes back to the system at its end."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa


def release() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        # Other C libraries have no such call, and give memory back by themselves.
        return


def lean(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """A function of a partition's batches that releases memory when it ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            release()

    return run


def lean_group(work: Callable[[pa.Table], pa.Table]) -> Callable:
    """A function of a group's table, likewise."""

    def run(table: pa.Table) -> pa.Table:
        try:
            return work(table)
        finally:
            release()

    return run


def lean_cogroup(work: Callable[[pa.Table, pa.Table], pa.Table]) -> Callable:
    """A function of two groups' tables, likewise."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        try:
            return work(left, right)
        finally:
            release()

    return run
