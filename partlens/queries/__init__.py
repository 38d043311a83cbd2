"""Queries over the driver's tables, grouped by subject."""

from . import agreements, code, contracts, graphs, inferences, records, scores, summaries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
