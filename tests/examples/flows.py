"""Workflows for the command line tests."""

from taskloom import task, workflow


@task
def add(x: int, y: int) -> int:
    return x + y


@workflow
def math_flow(x: int, y: int, factor: int = 2) -> int:
    """Adds and multiplies."""
    return add(x, y) * factor


@workflow
def failing_flow(x: int) -> int:
    raise ValueError(f"bad {x}")


@workflow
async def async_flow(flag: bool = False) -> bool:
    return flag
