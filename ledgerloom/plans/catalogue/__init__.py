"""The query catalogue."""

from . import checks, ledgers, normal, normalfiles, parties, texts, timelines, views  # noqa: F401  (modules register their queries)
from .base import QUERIES, Query, Tables

__all__ = ["QUERIES", "Query", "Tables"]
