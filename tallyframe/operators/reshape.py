"""Long and wide. Pivots are conditional aggregates over a given value list: one shuffle, fixed names."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.operators import selectors
from tallyframe.operators.encode import MAX_LEVELS


def gather(
    df: DataFrame,
    columns: Iterable[str],
    variable: str = "variable",
    value: str = "valor",
) -> DataFrame:
    """Wide to long; every column not named stays as an id, missing cells are kept."""
    columns = selectors.one_of(df, columns)
    ids = [c for c in df.columns if c not in columns]
    return df.unpivot(ids, columns, variable, value)


def key_text(columns: Iterable[str], sep: str = "_") -> Column:
    """The columns' texts joined by ``sep``; a missing part reads ``NA``."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("NA")) for c in columns]
    return F.concat_ws(sep, *parts)


def unite(
    df: DataFrame, name: str, columns: Iterable[str], sep: str = "_", remove: bool = True
) -> DataFrame:
    columns = selectors.one_of(df, columns)
    made = key_text(columns, sep)
    kept = [c for c in df.columns if c != name and not (remove and c in columns)]
    return df.select(*kept, made.alias(name))


def key_values(df: DataFrame, key: str, max_levels: int = MAX_LEVELS) -> list[str]:
    """Sorted distinct values of a pivot key; more than ``max_levels`` is an error."""
    rows = df.select(F.col(key).cast("string").alias("k")).distinct().limit(max_levels + 1).collect()
    if len(rows) > max_levels:
        raise ValueError(f"pivot key {key!r} has more than {max_levels} values")
    found = {r.k for r in rows}
    if {None, "NA"} <= found:
        raise ValueError(f"pivot key {key!r} has both missing values and the text 'NA': one column name for both")
    return sorted("NA" if k is None else k for k in found)


def _single_cell(key: Column, key_value: str, value: Column) -> Column:
    hit = key == F.lit(key_value)
    rows = F.count(F.when(hit, F.lit(1)))
    return F.when(
        rows > 1, F.raise_error(F.lit(f"several rows for one cell of column {key_value}"))
    ).otherwise(F.max(F.when(hit, value)))


def spread(
    df: DataFrame,
    key: str,
    value: str,
    values: Iterable[str] | None = None,
    fill=None,
) -> DataFrame:
    """Long to wide. A repeated (ids, key) pair raises; ``fill`` replaces absent and missing cells alike."""
    values = list(values) if values is not None else key_values(df, key)
    ids = [c for c in df.columns if c not in (key, value)]
    text = F.coalesce(F.col(key).cast("string"), F.lit("NA"))
    cells = []
    for v in values:
        cell = _single_cell(text, v, F.col(value))
        cells.append((cell if fill is None else F.coalesce(cell, F.lit(fill))).alias(v))
    return df.groupBy(*ids).agg(*cells)


def spread_multiple(
    df: DataFrame,
    keys: Iterable[str],
    values: Iterable[str],
    combos: Iterable[str] | None = None,
    fill=None,
    sep: str = "_",
) -> DataFrame:
    """Pivot by several keys and several values at once: columns ``<key1>_<key2>[_<value>]``."""
    keys, values = selectors.one_of(df, keys), selectors.one_of(df, values)
    ids = [c for c in df.columns if c not in (*keys, *values)]
    text = key_text(keys, sep)
    if combos is None:
        combos = key_values(df.select(text.alias("k")), "k")
    cells = []
    for combo in combos:
        for v in values:
            cell = _single_cell(text, combo, F.col(v))
            name = f"{combo}{sep}{v}" if len(values) > 1 else combo
            cells.append((cell if fill is None else F.coalesce(cell, F.lit(fill))).alias(name))
    return df.groupBy(*ids).agg(*cells)


def period_pivot(
    df: DataFrame,
    keys: Iterable[str],
    periods: Mapping[str, Column],
    measures: Mapping[str, Callable[[Column], Column]],
    fill=None,
) -> DataFrame:
    """Aggregate and pivot in one pass: a column ``<measure>_<period>`` per measure and period.

    ``measures`` maps an output name to a function from a row predicate to an aggregate. Nothing
    is unpivoted, and the only shuffle is the one on ``keys``.
    """
    cells = []
    for name, fn in measures.items():
        for period, condition in periods.items():
            cell = fn(condition)
            cells.append(
                (cell if fill is None else F.coalesce(cell, F.lit(fill))).alias(f"{name}_{period}")
            )
    return df.groupBy(*keys).agg(*cells)
