"""Composable tasks and workflows over Spark."""

from taskloom.operators.compose import chain, flat_map, gather_actions, gather_tasks, indexed, load_dataset, map_frame, map_or_first_error, map_tasks, save_dataset, table_function, zip_frames
from taskloom.operators.task import Task, task
from taskloom.plans.session import async_session, session
from taskloom.plans.workflow import Workflow, load_workflow, workflow
from taskloom.settings import Settings

__all__ = [
    "Settings", "Task", "Workflow", "async_session", "chain", "flat_map", "gather_actions", "gather_tasks", "indexed", "load_dataset", "load_workflow",
    "map_frame", "map_or_first_error", "map_tasks", "save_dataset", "session", "table_function", "task", "workflow", "zip_frames",
]
