"""One-hot encoding with a level list that is resolved once and reused.

Levels become columns, so they must be known before the plan is built. They are found for all
categorical columns in one job, and the resulting :class:`LevelSpec` can be stored and applied
to any later table, which then gets exactly the same columns.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.scalar import clean_level
from tallyframe.operators import selectors

MAX_LEVELS = 200


@dataclass(frozen=True)
class LevelSpec:
    """``levels[variable][indicator column]`` is the list of raw levels (None = missing) it marks."""

    levels: Mapping[str, Mapping[str, list]]

    def to_json(self) -> str:
        return json.dumps(self.levels, sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> LevelSpec:
        return cls(json.loads(text))

    @property
    def variables(self) -> list[str]:
        return list(self.levels)

    def indicators(self, variable: str | None = None) -> dict[str, Column]:
        """Indicator column name -> 0/1 expression (never NULL)."""
        names = [variable] if variable else self.variables
        columns = {v: F.col(v) for v in names}
        return {
            name: _is_any(columns[v], raw).cast("int")
            for v in names
            for name, raw in self.levels[v].items()
        }


def _is_any(c: Column, raw: list) -> Column:
    """Null-safe membership: never NULL, and a missing level matches a missing value."""
    return reduce(lambda a, b: a | b, [c.eqNullSafe(r) for r in raw])


def distinct_levels(
    df: DataFrame, columns: Iterable[str], max_levels: int = MAX_LEVELS
) -> list[tuple[str, str | None, str]]:
    """(variable, raw level, cleaned level) of every column, in one job.

    Only distinct pairs leave the map side, and no more than the permitted number of them reaches
    the driver. A column with more levels is an error: it is not a category, and leaving some of
    its levels out would be wrong.
    """
    columns = selectors.one_of(df, columns)
    long = df.select(*[F.col(c).cast("string").alias(c) for c in columns])
    if len(columns) > 1:
        pairs = long.unpivot([], columns, "variable", "level")
    else:
        pairs = long.select(F.lit(columns[0]).alias("variable"), F.col(columns[0]).alias("level"))
    rows = (
        pairs.distinct()
        .limit(max_levels * len(columns) + 1)
        .select("variable", "level", clean_level("level").alias("clean"))
        .collect()
    )
    counts: dict[str, int] = {}
    for r in rows:
        counts[r.variable] = counts.get(r.variable, 0) + 1
    wide = {v: n for v, n in counts.items() if n > max_levels}
    if wide:
        raise ValueError(f"more than {max_levels} levels, not a category: {sorted(wide)}")
    return sorted(
        [(r.variable, r.level, r.clean) for r in rows], key=lambda t: (t[0], t[2], t[1] or "")
    )


def resolve_levels(
    df: DataFrame,
    columns: Iterable[str],
    max_levels: int = MAX_LEVELS,
    prefix_names: bool = True,
) -> LevelSpec:
    """Level list of the named columns; raw levels that clean to the same name share one indicator.

    A name that another variable's level, or a column that stays, has already gets ``_2``, ``_3`` and so
    on, variables taken in the order given: no level is lost.
    """
    columns = list(columns)
    taken = {c.lower() for c in df.columns if c not in columns}
    levels: dict[str, dict[str, list]] = {c: {} for c in columns}
    for variable, raw, clean in distinct_levels(df, columns, max_levels):
        if prefix_names:
            name = f"{variable}_{clean}"
        elif raw is None:
            continue
        else:
            name = raw
        levels[variable].setdefault(name, []).append(raw)
    if not prefix_names:
        return LevelSpec(levels)
    named: dict[str, dict[str, list]] = {}
    for variable in columns:
        named[variable] = {}
        for name, raws in levels[variable].items():
            free, i = name, 1
            while free.lower() in taken:
                i += 1
                free = f"{name}_{i}"
            taken.add(free.lower())
            named[variable][free] = raws
    return LevelSpec(named)


def one_hot_plain(df: DataFrame, column: str, levels: Iterable[str] | None = None) -> DataFrame:
    """A 0/1 column named after each raw level; the source column goes. A missing level gives NULLs."""
    if levels is None:
        levels = list(resolve_levels(df, [column], prefix_names=False).levels[column])
    made = [(F.col(column) == F.lit(v)).cast("int").alias(v) for v in levels]
    return df.select(*[F.col(c) for c in df.columns if c != column], *made)


def one_hot_named(
    df: DataFrame,
    columns: Iterable[str],
    spec: LevelSpec | None = None,
    max_levels: int = MAX_LEVELS,
) -> DataFrame:
    """A 0/1 column ``VARIABLE_LEVEL`` per cleaned level of every named column; the source columns go."""
    columns = selectors.one_of(df, columns)
    spec = spec or resolve_levels(df, columns, max_levels)
    made = [e.alias(n) for c in columns for n, e in spec.indicators(c).items()]
    return df.select(*[F.col(c) for c in df.columns if c not in columns], *made)


def level_counts(
    df: DataFrame,
    keys: Iterable[str],
    columns: Iterable[str],
    spec: LevelSpec | None = None,
    max_levels: int = MAX_LEVELS,
) -> DataFrame:
    """Rows per key and level, one column per level: one-hot and sum without the wide middle table."""
    columns = selectors.one_of(df, columns)
    spec = spec or resolve_levels(df, columns, max_levels)
    sums = [F.sum(e).alias(n) for c in columns for n, e in spec.indicators(c).items()]
    return df.groupBy(*keys).agg(*sums)


# ---- many levels: indicators by hash

HASH_BUCKETS = 256


def hash_bucket(variable: str, value: Column, buckets: int = HASH_BUCKETS) -> Column:
    """Which of ``buckets`` indicators a level of a variable falls to; a missing level is a level of its own."""
    text = F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit(""))
    digest = F.md5(F.concat(F.lit(variable + ":"), text).cast("binary"))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % F.lit(buckets)).cast("int")


def hashed_indicators(
    df: DataFrame, columns: Iterable[str], buckets: int = HASH_BUCKETS, name: str = "hashed"
) -> DataFrame:
    """The columns replaced by one sparse vector: the indicators that a row has, in order and each once.

    However many levels there are, now or later, no pass looks for them and the vector has ``buckets`` places. Levels
    that share a place are told by :func:`hash_collisions`.
    """
    chosen = selectors.one_of(df, columns)
    places = F.array_sort(F.array_distinct(F.array(*[hash_bucket(c, F.col(f"`{c}`"), buckets) for c in chosen])))
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c not in chosen], places.alias(name))


def hash_collisions(df: DataFrame, columns: Iterable[str], buckets: int = HASH_BUCKETS) -> DataFrame:
    """(bucket, n_rows, n_levels) of every place that is used: cells that fall to it, and distinct levels of all columns."""
    chosen = selectors.one_of(df, columns)
    cell = lambda c: F.struct(F.lit(c).alias("variable"), F.col(f"`{c}`").cast("string").alias("level"), hash_bucket(c, F.col(f"`{c}`"), buckets).alias("bucket"))
    levels = df.select(F.inline(F.array(*[cell(c) for c in chosen]))).groupBy("bucket", "variable", "level").agg(F.count(F.lit(1)).alias("n"))
    return levels.groupBy("bucket").agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_levels"))
