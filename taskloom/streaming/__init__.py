"""Streams: rows pulled by the driver, and event-time windows over Structured Streaming."""

from taskloom.streaming.streams import pull, windowed_counts, write_once

__all__ = ["pull", "windowed_counts", "write_once"]
