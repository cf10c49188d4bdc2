"""Small functions that the other layers share: templates, durations and types."""

from taskloom.functions.formatting import duration_column, format_duration
from taskloom.functions.templates import placeholders, resolve, template_column
from taskloom.functions.types import coerce, spark_type

__all__ = ["coerce", "duration_column", "format_duration", "placeholders", "resolve", "spark_type", "template_column"]
