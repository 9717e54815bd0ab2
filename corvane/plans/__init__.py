"""All queries of the library, by name, and their SQL."""

from __future__ import annotations

from . import aggregates, joins, outputs, scalars, scans, similarity, structures, windows
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "aggregates", "joins", "outputs", "scalars", "scans", "similarity", "structures", "windows"]
