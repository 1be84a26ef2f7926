"""All registered queries of the engine."""

from __future__ import annotations

from . import aggregates, extraction, policy_queries, relations, shapes, stateful, windows  # noqa: F401  they register
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
