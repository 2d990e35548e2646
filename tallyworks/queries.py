"""All named queries. Importing the plan modules registers them."""

from .plans import catalog, inbox, merging, ordered, payloads, rulebook, stories, streams, timeline, upkeep  # noqa: F401
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
