"""All queries of the archive."""

from __future__ import annotations

from . import changes, relations, roundtrips, scalars, searches
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "changes", "relations", "roundtrips", "scalars", "searches"]
