"""Joins and set operations on explicit keys.

No side is broadcast by hand: rollups grow with the data, so the choice is left to Catalyst and
adaptive execution, which look at real sizes and split skewed partitions.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def left_join(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left equi-join on ``on``; any other shared name would be ambiguous and is refused."""
    on = list(on)
    low = {c.lower() for c in on}
    _refuse({c.lower() for c in left.columns} & {c.lower() for c in right.columns} - low)
    return left.join(right, on, "left")


def _refuse(shared: set[str]) -> None:
    if shared:
        raise ValueError(f"both sides also share {sorted(shared)}; rename or add them to the key")


def star_join(subject: DataFrame, rollups: Iterable[DataFrame], on: Sequence[str]) -> DataFrame:
    """Left-join rollups, each with one row per key, onto the subject table.

    Every side crosses the joins as one struct and is unpacked at the end: a join then copies one
    block of bytes per side instead of hundreds of single columns, join after join.
    """
    on = list(on)
    rest = [c for c in subject.columns if c not in on]
    sides = [("__s", rest)]
    out = subject.select(*on, F.struct(*rest).alias("__s"))
    seen = {c.lower() for c in subject.columns}
    for i, rollup in enumerate(rollups):
        columns = [c for c in rollup.columns if c not in on]
        _refuse(seen & {c.lower() for c in columns})
        seen |= {c.lower() for c in columns}
        sides.append((f"__r{i}", columns))
        out = out.join(rollup.select(*on, F.struct(*columns).alias(f"__r{i}")), on, "left")
    return out.select(*on, *[F.col(f"{side}.{c}") for side, columns in sides for c in columns])


def semi_join(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of ``left`` whose key occurs in ``right``.

    The right keys are made distinct first: that happens on the map side, so a key that fills a
    large part of ``right`` is shuffled once per task.
    """
    return left.join(right.select(*on).distinct(), list(on), "left_semi")


def bind_rows(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Union by name; a column one table lacks is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), others, first)


def set_difference(
    left: DataFrame, right: DataFrame, key: Sequence[str] | None = None
) -> DataFrame:
    """Distinct rows of ``left`` that ``right`` lacks; with a unique ``key`` only the key is compared.

    Copies are merged on the map side before they can meet in one task.
    """
    if key is None:
        return left.distinct().subtract(right.distinct())
    return left.join(right.select(*key).distinct(), list(key), "left_anti")


def store_bucketed(df: DataFrame, on: Sequence[str], name: str, path: str, buckets: int) -> DataFrame:
    """Writes ``df`` as a table bucketed and sorted by its key, and returns the stored table. Tables with as many buckets join
    and aggregate on that key without a shuffle, in this job and in later ones.

    The table stays in the session's catalog under ``name``, its files below ``path``."""
    on = list(on)
    writer = df.repartition(buckets, *on).write.mode("overwrite").option("path", path)
    writer.bucketBy(buckets, *on).sortBy(*on).saveAsTable(name, format="parquet")
    return df.sparkSession.table(name)
