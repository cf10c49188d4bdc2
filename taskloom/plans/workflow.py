"""Workflows: named entry points with typed parameters."""

from __future__ import annotations

import functools
import importlib
import inspect
import typing
from collections.abc import Callable
from typing import Any

from taskloom import scope
from taskloom.plans.session import async_session, session


class Workflow:
    """A function that runs inside a session: the active one, or one of its own."""

    def __init__(self, func: Callable, name: str | None = None, description: str | None = None):
        self.func = func
        self.name = name or func.__name__
        self.description = description if description is not None else inspect.getdoc(func) or ""
        self.is_async = inspect.iscoroutinefunction(func)
        functools.update_wrapper(self, func)

    @property
    def signature(self) -> inspect.Signature:
        return inspect.signature(self.func)

    @property
    def parameters(self) -> dict[str, Any]:
        """Annotations by parameter; ``inspect.Parameter.empty`` for untyped ones."""
        try:
            hints = typing.get_type_hints(self.func)
        except Exception:
            hints = {}
        return {n: hints.get(n, p.annotation if not isinstance(p.annotation, str) else inspect.Parameter.empty) for n, p in self.signature.parameters.items()}

    @property
    def is_typed(self) -> bool:
        return all(a is not inspect.Parameter.empty for a in self.parameters.values())

    def __call__(self, *args: Any, **kwargs: Any) -> Any:
        if self.is_async:
            return self._run(*args, **kwargs)
        if scope.current_session():
            return self.func(*args, **kwargs)
        with session():
            return self.func(*args, **kwargs)

    async def _run(self, *args: Any, **kwargs: Any) -> Any:
        if scope.current_session():
            return await self.func(*args, **kwargs)
        async with async_session():
            return await self.func(*args, **kwargs)


def workflow(func: Callable | None = None, *, name: str | None = None, description: str | None = None) -> Any:
    """Makes a function a workflow, bare or with options."""

    def wrap(f: Callable) -> Workflow:
        if isinstance(f, type) or not callable(f):
            raise TypeError("a workflow is made of a function")
        if inspect.isgeneratorfunction(f) or inspect.isasyncgenfunction(f):
            raise TypeError("a workflow can't be a generator")
        return Workflow(f, name, description)

    return wrap if func is None else wrap(func)


def load_workflow(path: str) -> Workflow:
    """The workflow at ``package.module.name``."""
    module, _, name = path.rpartition(".")
    if not module:
        raise ValueError(f"{path!r} is no path of a module and a name")
    found = getattr(importlib.import_module(module), name)
    if not isinstance(found, Workflow):
        raise TypeError(f"{path!r} is no workflow")
    return found
