"""Imports every registry module so that all queries are known."""

from recfuse.registry import changes, cleaning, dedup, extraction, fusion, serving, statistics, streams, triage  # noqa: F401
from recfuse.registry.base import QUERIES

__all__ = ["QUERIES"]
