"""The query catalogue."""

from . import display, growing, logging, merging, priced, reviewed, scorecards, status, totals, upkeep
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "display", "growing", "logging", "merging", "priced", "reviewed", "scorecards", "status", "totals", "upkeep"]
