"""Text columns as whole numbers that keep their order: one stored code table for all parts of a data set."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.operators import selectors
from tallyframe.session import cut_lineage

RANGE_VALUES = 1_000_000  # distinct values that one task sorts
UNSEEN = 0


def code_table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(variable, value, code): per column its distinct non-missing values, numbered from 1 in code point order.

    Distinct values are dealt to ranges of the order, numbered inside them, and moved up by the values of the ranges
    before: no task sorts a whole column, and a frequent value is one row per task before any shuffle.
    """
    chosen = selectors.one_of(df, columns)
    if not chosen:
        return df.sparkSession.createDataFrame([], "variable string, value string, code bigint")
    cells = F.array(*[F.struct(F.lit(c).alias("variable"), F.col(f"`{c}`").cast("string").alias("value")) for c in chosen])
    distinct = cut_lineage(df.select(F.inline(cells)).filter(F.col("value").isNotNull()).distinct())
    ranges = max(1, -(-distinct.count() // RANGE_VALUES))
    placed = cut_lineage(
        distinct.repartitionByRange(ranges, "variable", "value")
        .sortWithinPartitions("variable", "value")
        .withColumn("place", F.monotonically_increasing_id())
        .withColumn("range", F.shiftright("place", 33))
    )
    parts = placed.groupBy("variable", "range").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("variable").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    # A row per range, and one more per variable.
    offsets = F.broadcast(
        parts.select("variable", "range", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    )
    number = F.col("place") - F.col("first") + F.col("offset") + 1
    return cut_lineage(placed.join(offsets, ["variable", "range"]).select("variable", "value", number.alias("code")))


def apply_codes(df: DataFrame, codes: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns replaced by their codes: NULL stays NULL, a value that the table lacks becomes ``UNSEEN``.

    How each column's codes are joined is left to their size: few levels are looked up on the map side, many meet the
    rows in a shuffle that adaptive execution splits where one value is frequent.
    """
    out = df
    for i, c in enumerate(selectors.one_of(df, columns)):
        value, code = f"__value_{i}", f"__code_{i}"
        own = codes.filter(F.col("variable") == c).select(F.col("value").alias(value), F.col("code").alias(code))
        coded = F.when(F.col(f"`{c}`").isNotNull(), F.coalesce(F.col(code), F.lit(UNSEEN))).cast("bigint")
        out = out.join(own, F.col(f"`{c}`") == F.col(value), "left").withColumn(c, coded).drop(value, code)
    return out.select(*[F.col(f"`{c}`") for c in df.columns])
