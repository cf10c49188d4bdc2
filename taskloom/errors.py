"""Exceptions of the engine."""


class TaskloomError(Exception):
    """Base of all exceptions raised here."""


class TaskError(TaskloomError):
    """A task failed after all its attempts."""


class ParameterError(TaskError):
    """A task's arguments can't be used as they are."""


class TaskTimeout(TaskError):
    """A task ran longer than it may."""


class BackendError(TaskloomError):
    """An execution strategy is unknown or unusable."""


class DatasetError(TaskloomError):
    """A dataset type is declared wrongly."""


class Uncacheable(TaskloomError):
    """A value has no key that would be stable and tell apart what differs."""
