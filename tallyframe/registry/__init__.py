"""Registered queries: every operator bound to the given tables, with the SQL that checks it."""

from tallyframe.registry import basics, profiling, recipes, scale, scoring, sql_surface, storage  # noqa: F401
from tallyframe.registry.core import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
