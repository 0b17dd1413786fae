"""All reference-operator queries and their SQL, gathered from the plan modules."""

from __future__ import annotations

from . import checks, extraction, graphs, relations, searching, sources  # noqa: F401  each registers its queries
from .tables import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
