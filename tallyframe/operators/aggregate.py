"""Grouped fan-outs, frequency tables and rates."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions import aggregates as A
from tallyframe.functions.scalar import percent_label
from tallyframe.operators import selectors

Agg = Callable[[str], Column]

FIVE_FUNCTIONS: dict[str, Agg] = {
    "N": lambda c: A.row_count(),
    "MAX_BUREAU": A.max_skip,
    "MIN_BUREAU": A.min_skip,
    "SUM_BUREAU": A.sum_skip,
    "MEAN_BUREAU": A.mean_skip,
}
STRICT_SUM_COUNT: dict[str, Agg] = {"SUM": A.strict_sum, "N": lambda c: A.row_count()}
SUM_COUNT: dict[str, Agg] = {"sum": A.sum_skip, "n": lambda c: A.row_count()}
SUM_MEAN: dict[str, Agg] = {"SUM": A.sum_skip, "MEAN": A.mean_skip}
EXACT_SUM_MEAN: dict[str, Agg] = {"SUM": A.exact_sum, "MEAN": A.exact_mean}


def fan_out(
    df: DataFrame,
    keys: Iterable[str],
    columns: Iterable[str],
    functions: Mapping[str, Agg],
) -> DataFrame:
    """One aggregate named ``<column>_<function>`` per column and function; an empty name adds no suffix."""
    exprs = [
        fn(c).alias(f"{c}_{name}" if name else c)
        for c in selectors.one_of(df, columns)
        for name, fn in functions.items()
    ]
    return df.groupBy(*keys).agg(*exprs)


def fan_out_numeric(
    df: DataFrame, keys: Iterable[str], functions: Mapping[str, Agg], exclude: Iterable[str] = ()
) -> DataFrame:
    keys = list(keys)
    return fan_out(df, keys, selectors.numeric(df, [*keys, *exclude]), functions)


def fan_out_all(
    df: DataFrame, keys: Iterable[str], functions: Mapping[str, Agg], exclude: Iterable[str] = ()
) -> DataFrame:
    skip = {*keys, *exclude}
    return fan_out(df, list(keys), [c for c in df.columns if c not in skip], functions)


def sum_all(df: DataFrame, keys: Iterable[str], exclude: Iterable[str] = ()) -> DataFrame:
    return fan_out_all(df, keys, {"": A.sum_skip}, exclude)


def frequency_table(df: DataFrame, column: str, digits: int | None = None) -> DataFrame:
    """Rows per level with their share, and the share among non-missing levels (NULL for the missing one).

    The totals are a scalar subquery over the same grouped counts, whose shuffle is reused: the
    input is read once and there is no join.
    """
    present = F.col(column).isNotNull()
    freq = df.groupBy(column).agg(A.row_count().alias("n"))
    totals = freq.agg(
        F.struct(F.sum("n").alias("all"), F.sum(F.when(present, F.col("n"))).alias("valid"))
    ).scalar()
    share = F.col("n") / totals["all"]
    valid_share = F.when(present, F.col("n") / totals["valid"])
    if digits is not None:
        share, valid_share = F.bround(share, digits), F.bround(valid_share, digits)
    return freq.select(column, "n", share.alias("percent"), valid_share.alias("valid_percent"))


def with_overall_mean(df: DataFrame, column: str, name: str = "prop") -> DataFrame:
    """Whole-table mean beside each row: a scalar subquery, not an unpartitioned window."""
    overall = df.agg(F.try_divide(F.sum(column).cast("double"), F.count(column))).scalar()
    return df.withColumn(name, overall)


def rate_by_level(df: DataFrame, target: str, column: str) -> DataFrame:
    """Target rate of every level of one column, with the overall rate and a percent label.

    A missing target makes its level's rate missing, and the overall one."""
    counts = df.groupBy(column).agg(
        A.row_count().alias("n"),
        F.sum(target).alias("positives"),
        F.count(target).alias("known"),
    )
    overall = counts.agg(strict_rate(F.sum("positives"), F.sum("known"), F.sum("n"))).scalar()
    return counts.select(
        column,
        overall.alias("prop"),
        "n",
        strict_rate(F.col("positives"), F.col("known"), F.col("n")).alias("rate"),
    ).withColumn("label", percent_label("rate"))


def strict_rate(positives: Column, known: Column, n: Column) -> Column:
    """Positives over rows, missing where a row's target is."""
    return F.when(known == n, F.try_divide(positives.cast("double"), n))


def distinct_count(df: DataFrame, column: str, name: str = "n_distinct") -> DataFrame:
    """Number of distinct values, a missing value counting as one of them."""
    return df.agg(
        (F.count_distinct(column) + F.max(F.when(F.col(column).isNull(), 1).otherwise(0)))
        .cast("bigint")
        .alias(name)
    )


def quality_counts(df: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    """How many rows meet each named condition, all in one scan."""
    return df.agg(*[A.count_where(cond).alias(name) for name, cond in checks.items()])
