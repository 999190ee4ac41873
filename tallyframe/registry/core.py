"""Registry of queries and access to the tables they read."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.operators import selectors
from tallyframe.registry import bindings
from tallyframe.sources.readers import read_parquet

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The given tables by name, and the history tables derived from them (see ``bindings``)."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._read: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._read:
            self._read[name] = read_parquet(self.spark, self.folder, name)
        return self._read[name]

    def bound(self, name: str) -> DataFrame:
        source, columns = bindings.BOUND[name]
        return getattr(self, source).selectExpr(*[f"{e} AS {n}" for n, e in columns.items()])

    @cached_property
    def subject(self) -> DataFrame:
        return self.bound("subject")


def query(name: str, sql: str | None = None):
    """Register ``fn(tables)``; without ``sql`` only its rows can be checked."""

    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def rounded(df: DataFrame, columns, digits: int) -> DataFrame:
    """Round sums of inexact doubles, whose last bits depend on the order of addition."""
    return selectors.map_columns(df, columns, lambda c: F.round(c, digits))
