import asyncio

import pytest

from taskloom import async_session, load_workflow, map_tasks, session, task, workflow
from taskloom.cli import main
from taskloom.errors import BackendError
from taskloom.plans.hooks import CentralLog, EventLog, EventRegistry, get_logger, emit, has_plugin, register_plugins, reset_plugins
from taskloom.scope import current_session
from taskloom.settings import Settings, get_global_settings, set_global_settings

FLOWS = "tests.examples.flows"


def test_sessions_nest_and_end():
    assert current_session() is None
    with session(backend="threads") as outer, session() as inner:
        assert inner.backend == "threads" and inner.id != outer.id
    assert current_session() is None
    with pytest.raises(BackendError, match="available"), session(backend="nope"):
        pass

    async def run():
        async with async_session() as s:
            return s.id

    assert asyncio.run(run())


def test_workflow_joins_the_active_session():
    @workflow
    def which():
        return current_session().id

    with session() as s:
        assert which() == s.id
    assert which() and current_session() is None
    with pytest.raises(TypeError):
        workflow(int)
    assert load_workflow(f"{FLOWS}.math_flow")(x=1, y=2) == 6
    with pytest.raises(TypeError):
        load_workflow(f"{FLOWS}.add")


def test_event_rows(spark):
    log = EventLog()

    @task
    def inner(x):
        return x

    @task
    def outer(x):
        return inner(x)

    with session(plugins=[log]) as s:
        map_tasks(outer, [1, 2])
    rows = log.frame(spark).collect()
    assert {r.session_id for r in rows} == {s.id}
    begun = {r.task_id: r for r in rows if r.event == "before_node_execute"}
    assert sorted(r.name for r in begun.values()) == ["inner[0]", "inner[1]", "outer[0]", "outer[1]"]
    assert all(begun[r.parent_id].name.startswith("outer") for r in begun.values() if r.name.startswith("inner"))
    assert [r.event for r in rows][0] == "before_session_start" and [r.event for r in rows][-1] == "after_session_end"


def test_handlers_are_contained_and_hooks_are_not():
    seen, registry = [], EventRegistry()
    registry.register("a", lambda d: 1 / 0)
    registry.register("a", seen.append)
    registry.dispatch("a", {"x": 1})
    assert seen == [{"x": 1}]

    class Bad:
        def before_node_execute(self, metadata):
            raise RuntimeError("hook")

    with session(plugins=[Bad()]), pytest.raises(RuntimeError, match="hook"):
        task(lambda: 1)()


def test_plugins_are_instances():
    class P:
        def before_session_start(self, session_id):
            pass

    with pytest.raises(TypeError):
        register_plugins(P)
    with pytest.raises(TypeError):
        register_plugins(object())
    p = P()
    register_plugins(p, p)
    assert has_plugin(p)
    reset_plugins()
    assert not has_plugin(p)


def test_settings(spark, monkeypatch):
    monkeypatch.setenv("TASKLOOM_CACHE_STORE", "elsewhere")
    assert Settings().cache_store == "elsewhere"
    assert Settings().overridden({"max_backend_threads": "3", "trace_hooks": "yes"}).max_backend_threads == 3
    with pytest.raises(ValueError, match="unknown"):
        Settings().overridden({"nope": "1"})
    set_global_settings(Settings(backend="threads"))
    assert get_global_settings().backend == "threads"
    set_global_settings(None)
    spark.conf.set("spark.taskloom.backend", "distributed")
    assert Settings.of_session(spark).backend == "distributed"
    spark.conf.unset("spark.taskloom.backend")


def test_logger_names_the_task(caplog):
    @task
    def speak():
        get_logger("t").warning("hi")

    speak()
    assert "[speak] hi" in caplog.text


def test_cli(capsys):
    assert main(["list", FLOWS]) == 0
    assert "math_flow  Adds and multiplies." in capsys.readouterr().out
    for target in (f"{FLOWS}:math_flow", f"{FLOWS}.math_flow", "tests/examples/flows.py:math_flow"):
        assert main(["run", target, "--x", "5", "--y", "10", "--show", "1"]) == 0
        assert capsys.readouterr().out == "30\n"
    assert main(["describe", f"{FLOWS}:math_flow", "--", "--x", "1", "--y", "2"]) == 0
    assert "factor = 2 (int)" in capsys.readouterr().out
    assert main(["run", f"{FLOWS}:async_flow", "--flag", "yes", "--show", "1"]) == 0
    assert capsys.readouterr().out == "True\n"
    assert main(["run", f"{FLOWS}:failing_flow", "--x", "1"]) == 2
    assert "bad 1" in capsys.readouterr().err
    assert main(["run", f"{FLOWS}:absent"]) == 1
    for tail in (["--x", "5"], ["--x", "no", "--y", "1"]):
        with pytest.raises(SystemExit):
            main(["run", f"{FLOWS}:math_flow", *tail])
    assert main(["run", f"{FLOWS}:math_flow", "--x", "1", "--y", "1", "--conf", "backend=threads"]) == 0
    assert main(["run", f"{FLOWS}:math_flow", "--x", "1", "--y", "1", "--conf", "nope=1"]) == 1


class Shout:
    """A plugin that executors can have: it sends an event for each task it sees."""

    def __init__(self, word):
        self.word, self.seen = word, []

    def to_config(self):
        return {"word": self.word}

    @classmethod
    def from_config(cls, config):
        return cls(config["word"])

    def before_node_execute(self, metadata):
        emit("shout", text=f"{self.word} {metadata.name}")

    def register_event_handlers(self, registry):
        registry.register("shout", lambda data: self.seen.append(data["text"]))


@pytest.mark.parametrize("backend", ["inline", "threads", "distributed"])
def test_events_and_logs_come_back_from_executors(spark, caplog, backend):
    @task
    def work(x):
        get_logger().warning("at %s", x)
        return x

    plugin = Shout("hey")
    with session(plugins=[plugin, CentralLog()]), caplog.at_level("WARNING"):
        assert map_tasks(work, [4, 5], backend=backend) == [4, 5]
    assert sorted(plugin.seen) == ["hey work[0]", "hey work[1]"]
    assert "[work[0]] at 4" in caplog.text and "[work[1]] at 5" in caplog.text


def test_dataset_plugins(monkeypatch, tmp_path):
    import importlib.metadata

    from taskloom.sources import DatasetStore, ValueFormat
    from taskloom.sources.datasets import extension_of, formats_for, infer_format, load_plugins

    class Good:
        name = "good"

        @staticmethod
        def load():
            return lambda: ValueFormat(complex, "pair", ("cpx",), lambda v: f"{v.real} {v.imag}".encode(), lambda b: complex(*map(float, b.split())))

    class Bad:
        name = "bad"

        @staticmethod
        def load():
            raise ImportError("gone")

    monkeypatch.setattr(importlib.metadata, "entry_points", lambda group: [Bad, Good])
    assert load_plugins() == ["good"]
    assert "pair" in formats_for(complex) and infer_format(complex, "cpx") == "pair" and extension_of(complex, "pair") == "cpx"
    store = DatasetStore(str(tmp_path))
    store.save("z.cpx", 1 + 2j)
    assert store.load("z.cpx", complex) == 1 + 2j
    with pytest.raises(ValueError, match="available"):
        store.load("z.cpx", complex, "nope")


def test_event_rows_keep_whole_values():
    log, text = EventLog(), "long error " * 100
    log._add("on_error", error=ValueError(text))
    assert log.rows()[0][-1] == {"error": text}


def test_contexts_are_entered_once_and_left_in_order():
    from taskloom import scope

    once = scope.at_index(1)
    with once:
        with pytest.raises(RuntimeError, match="entered before"):
            once.__enter__()
    with pytest.raises(RuntimeError, match="another order"):
        once.__exit__(None, None, None)
    first, second = scope.at_index(1), scope.at_index(2)
    first.__enter__()
    second.__enter__()
    with pytest.raises(RuntimeError, match="another order"):
        first.__exit__(None, None, None)
    second.__exit__(None, None, None)
    first.__exit__(None, None, None)
    assert scope.current_index() is None


def test_hooks_are_traced(caplog):
    with caplog.at_level("INFO", "taskloom"), session(settings=Settings(trace_hooks=True)):
        task(lambda: 1, name="t")()
    assert "hook before_node_execute" in caplog.text and "hook after_session_end" in caplog.text


def test_default_logging(tmp_path):
    import logging

    from taskloom.plans.hooks import configure_logging

    log = logging.getLogger("taskloom")
    before = log.handlers[:], log.level, log.propagate
    try:
        configure_logging("WARNING", str(tmp_path / "log.txt"))
        get_logger().info("no")
        get_logger().warning("yes")
        assert [line.split(" ", 2)[2].rstrip() for line in open(tmp_path / "log.txt")] == ["WARNING taskloom: yes"]
    finally:
        for h in log.handlers:
            h.close()
        log.handlers[:], log.level, log.propagate = before


def test_sessions_free_what_tasks_persisted(spark):
    @task(mode="table", retries=1)
    def rows():
        return spark.range(7)

    with session() as s:
        df = rows()
        assert df.is_cached and s.held == [df]
    assert not df.is_cached and df.count() == 7
