"""Importing this module registers every query."""

from postlens.catalog import models, rows, stats, text, vectors  # noqa: F401
from postlens.catalog.registry import MODULES, ORACLES, QUERIES

__all__ = ["MODULES", "ORACLES", "QUERIES"]
