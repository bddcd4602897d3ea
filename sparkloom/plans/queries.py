"""All queries of the library over the driver's tables, and their SQL."""

from . import extras, hotspots, profile, repairs, scores, services  # noqa: F401
from .hotspots import live
from .registry import QUERIES, SQL, events

__all__ = ["QUERIES", "SQL", "events", "live"]
