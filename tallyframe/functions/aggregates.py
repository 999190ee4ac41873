"""Aggregates with explicit missing-value rules.

``*_skip`` ignores missing values, ``strict_*`` is missing as soon as one row of the group is.
Every one is algebraic, so Spark combines it on the map side before any shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyframe.functions.scalar import as_col


def row_count() -> Column:
    return F.count(F.lit(1))


def sum_skip(c: Column | str) -> Column:
    return F.coalesce(F.sum(as_col(c)), F.lit(0))


def mean_skip(c: Column | str) -> Column:
    """Sum over count: shares both buffers with a sum and a count of the same column."""
    col = as_col(c)
    return F.try_divide(F.sum(col).cast("double"), F.count(col))


def max_skip(c: Column | str) -> Column:
    return F.max(as_col(c))


def min_skip(c: Column | str) -> Column:
    return F.min(as_col(c))


# Doubles are added as decimals with this many places, so that no order of addition shows.
EXACT = "decimal(28,6)"


def exact_sum(c: Column | str) -> Column:
    """Sum that ignores missing values and does not depend on how rows are spread: to 6 decimal places, up to 22
    digits before them; a larger amount fails the job. 0 of nothing."""
    return F.coalesce(F.sum(as_col(c).cast(EXACT)).cast("double"), F.lit(0.0))


def exact_mean(c: Column | str) -> Column:
    """Mean from the exact sum, with one rounding."""
    col = as_col(c)
    return F.try_divide(F.sum(col.cast(EXACT)).cast("double"), F.count(col))


def _complete(c: Column) -> Column:
    return F.count(c) == row_count()


def strict_sum(c: Column | str) -> Column:
    col = as_col(c)
    return F.when(_complete(col), F.sum(col))


def strict_mean(c: Column | str) -> Column:
    col = as_col(c)
    return F.when(_complete(col), mean_skip(col))


def strict_max(c: Column | str) -> Column:
    col = as_col(c)
    return F.when(_complete(col), F.max(col))


def strict_min(c: Column | str) -> Column:
    col = as_col(c)
    return F.when(_complete(col), F.min(col))


def count_where(condition: Column) -> Column:
    return F.count(F.when(condition, F.lit(1)))


def max_where(condition: Column, c: Column | str) -> Column:
    return F.max(F.when(condition, as_col(c)))


def missing_share(c: Column | str) -> Column:
    return F.avg(as_col(c).isNull().cast("int")) * 100


def rate(target: Column | str) -> Column:
    """Sum of a 0/1 target over the number of rows; missing as soon as one row's target is."""
    return F.try_divide(strict_sum(target).cast("double"), row_count())
