"""How work is run: sessions, workflows, execution strategies, caching and hooks."""

from taskloom.plans.backends import Backends
from taskloom.plans.cache import MISS, CacheStore, frame_key, value_key
from taskloom.plans.hooks import HOOKS, CentralLog, EventLog, EventRegistry, Hooks, LifecycleLog
from taskloom.plans.session import async_session, session
from taskloom.plans.workflow import Workflow, load_workflow, workflow

__all__ = [
    "HOOKS", "MISS", "Backends", "CacheStore", "CentralLog", "EventLog", "EventRegistry", "Hooks", "LifecycleLog", "Workflow",
    "async_session", "frame_key", "load_workflow", "session", "value_key", "workflow",
]
