"""Named queries on the driver tables with their SQL equivalents."""

from . import cleaning, geo, learning, portfolio, scoring, storage, survival
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "cleaning", "geo", "learning", "portfolio", "scoring", "storage", "survival"]
