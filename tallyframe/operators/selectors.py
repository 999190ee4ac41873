"""Choose columns by name pattern, type or data predicate, and apply one expression to all of them."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def starts_with(df: DataFrame, *prefixes: str) -> list[str]:
    low = tuple(p.lower() for p in prefixes)
    return [c for c in df.columns if c.lower().startswith(low)]


def ends_with(df: DataFrame, *suffixes: str) -> list[str]:
    low = tuple(s.lower() for s in suffixes)
    return [c for c in df.columns if c.lower().endswith(low)]


def contains(df: DataFrame, *parts: str) -> list[str]:
    low = [p.lower() for p in parts]
    return [c for c in df.columns if any(p in c.lower() for p in low)]


def one_of(df: DataFrame, names: Iterable[str]) -> list[str]:
    """The named columns, in the given order; a name the table lacks is an error, not a silent skip."""
    wanted, present = list(names), df.columns
    missing = sorted(set(wanted) - set(present))
    if missing:
        raise ValueError(f"no such column(s): {missing}; the table has {present}")
    return wanted


def numeric(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in skip]


def character(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def drop_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    return df.drop(*one_of(df, names))


def map_columns(df: DataFrame, names: Iterable[str], fn: Callable[[Column], Column]) -> DataFrame:
    """Replace every named column by ``fn`` of it, in a single projection."""
    chosen = one_of(df, names)
    return df.withColumns({c: fn(F.col(c)) for c in chosen}) if chosen else df


def names_frame(df: DataFrame, column: str = "variable_name") -> DataFrame:
    return df.sparkSession.createDataFrame([(c,) for c in df.columns], f"{column} string")


def tables_like(spark: SparkSession, pattern: str) -> list[str]:
    """Names of the session's tables and views that match a regular expression."""
    import re

    return sorted(t.name for t in spark.catalog.listTables() if re.search(pattern, t.name))
