"""Storage and datasets: what tasks read and write."""

from taskloom.sources.datasets import DatasetStore, FrameFormat, ValueFormat, register
from taskloom.sources.storage import Storage

__all__ = ["DatasetStore", "FrameFormat", "Storage", "ValueFormat", "register"]
