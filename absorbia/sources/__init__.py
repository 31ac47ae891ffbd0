"""Reading tables by path, checking them, and keeping results."""

from .cache import ResultStore
from .readers import StataSource, project, read, source_fingerprint

__all__ = ["ResultStore", "StataSource", "project", "read", "source_fingerprint"]
