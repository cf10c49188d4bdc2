"""Tasks and how they are put together."""

from taskloom.operators.compose import chain, flat_map, gather_tasks, indexed, load_dataset, map_frame, map_tasks, save_dataset, zip_frames
from taskloom.operators.task import Task, task

__all__ = ["Task", "chain", "flat_map", "gather_tasks", "indexed", "load_dataset", "map_frame", "map_tasks", "save_dataset", "task", "zip_frames"]
