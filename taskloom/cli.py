"""Command line: list, describe and run workflows."""

from __future__ import annotations

import argparse
import asyncio
import importlib
import inspect
import pkgutil
import sys
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame

from taskloom.functions.types import coerce
from taskloom.operators.compose import save_dataset
from taskloom.plans.hooks import LifecycleLog
from taskloom.plans.session import session
from taskloom.plans.workflow import Workflow
from taskloom.settings import get_global_settings


def _module(target: str) -> Any:
    """A module by dotted name or by file path."""
    if str(Path.cwd()) not in sys.path:
        sys.path.insert(0, str(Path.cwd()))
    if target.endswith(".py"):
        path = Path(target).resolve()
        if not path.is_file():
            raise ValueError(f"no file {target}")
        package = path.parent
        while (package / "__init__.py").exists():
            package = package.parent
        sys.path.insert(0, str(package))
        target = ".".join(path.relative_to(package).with_suffix("").parts)
    return importlib.import_module(target)


def discover(target: str) -> dict[str, Workflow]:
    """Workflows of a module and, for a package, of all modules below it; sorted by name."""
    module = _module(target)
    modules = [module]
    if hasattr(module, "__path__"):
        modules += [importlib.import_module(m.name) for m in pkgutil.walk_packages(module.__path__, f"{module.__name__}.") if not m.name.endswith("__main__")]
    found = {w.name: w for m in modules for w in vars(m).values() if isinstance(w, Workflow)}
    return dict(sorted(found.items()))


def find(target: str) -> Workflow:
    """``module:workflow``, ``module.workflow`` or ``path/to/file.py:workflow``."""
    module, colon, name = target.rpartition(":")
    if not colon:
        module, _, name = target.rpartition(".")
    if not module:
        raise ValueError(f"{target!r} names no module")
    found = discover(module)
    direct = getattr(_module(module), name, None)
    if isinstance(direct, Workflow):
        return direct
    if name not in found:
        raise ValueError(f"no workflow {name!r} in {module}; there are: {', '.join(found) or 'none'}")
    return found[name]


def arguments(workflow: Workflow, tail: list[str]) -> dict[str, Any]:
    """Values of ``--name value`` by the workflow's annotations."""
    parser = argparse.ArgumentParser(prog=workflow.name, description=workflow.description or None)
    for name, p in workflow.signature.parameters.items():
        kind, required = workflow.parameters[name], p.default is inspect.Parameter.empty

        def convert(text: str, kind: Any = kind) -> Any:
            return text if kind is inspect.Parameter.empty else coerce(text, kind)

        parser.add_argument(f"--{name.replace('_', '-')}", f"--{name}", dest=name, type=convert, required=required, default=None if required else p.default)
    return vars(parser.parse_args(tail))


def _overrides(pairs: list[str]) -> dict[str, str]:
    if bad := [p for p in pairs if "=" not in p]:
        raise ValueError(f"a setting is name=value, not {bad[0]!r}")
    return dict(p.split("=", 1) for p in pairs)


def _list(args: argparse.Namespace) -> int:
    for name, w in discover(args.module).items():
        summary = w.description.splitlines()[0] if w.description else ""
        print(f"{name}  {summary}".rstrip())
    return 0


def _describe(args: argparse.Namespace) -> int:
    w = find(args.target)
    print(f"{w.name}{w.signature}")
    if w.description:
        print(w.description)
    if args.tail:
        for name, value in arguments(w, args.tail).items():
            print(f"  {name} = {value!r} ({type(value).__name__})")
    return 0


def _run(args: argparse.Namespace) -> int:
    w = find(args.target)
    values = arguments(w, args.tail)
    settings = get_global_settings().overridden(_overrides(args.conf))
    try:
        with session(settings=settings, plugins=[LifecycleLog()]):
            result = asyncio.run(w(**values)) if w.is_async else w(**values)
            if args.save:
                print(save_dataset(args.save, result))
            if args.show:
                result.show(args.show, truncate=False) if isinstance(result, DataFrame) else print(result)
            if args.explain and isinstance(result, DataFrame):
                result.explain("formatted")
    except Exception as e:
        print(f"{w.name} failed: {e}", file=sys.stderr)
        return 2
    return 0


def main(argv: list[str] | None = None) -> int:
    argv = list(sys.argv[1:] if argv is None else argv)
    parser = argparse.ArgumentParser(prog="taskloom")
    commands = parser.add_subparsers(required=True)
    c = commands.add_parser("list", help="workflows of a module or file")
    c.add_argument("module")
    c.set_defaults(run=_list)
    c = commands.add_parser("describe", help="a workflow's parameters, and how given values are read")
    c.add_argument("target")
    c.set_defaults(run=_describe)
    c = commands.add_parser("run", help="runs a workflow")
    c.add_argument("target")
    c.add_argument("--show", type=int, default=0, metavar="N", help="print the result, of a DataFrame N rows")
    c.add_argument("--save", metavar="KEY", help="write the result as a dataset")
    c.add_argument("--explain", action="store_true", help="print the plan of a DataFrame")
    c.add_argument("--conf", action="append", default=[], metavar="NAME=VALUE", help="override a setting")
    c.set_defaults(run=_run)
    args, tail = parser.parse_known_args(argv)
    args.tail = [t for t in tail if t != "--"]
    try:
        return args.run(args)
    except (ValueError, ImportError, AttributeError) as e:
        print(e, file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
