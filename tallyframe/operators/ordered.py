"""Order-dependent work without a one-task sort: row numbers, running sums, exact quantiles.

The pattern is the same throughout. Range buckets with cut points from a quantile sketch split
the order into pieces of similar size, a grouped count per bucket gives each bucket's offset, and
only the inside of a bucket is ever sorted. The sketch decides how evenly work is spread, never
the result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

MIN_BUCKETS = 32
MAX_BUCKETS = 2048  # cut points of one column that pass the driver
FINE = 256  # parts of an overfull bucket
BUCKET_ROWS = 1_000_000
BROADCAST_ROWS = 200_000


def bucket_target(df: DataFrame) -> int:
    """A bucket for every BUCKET_ROWS rows, so that what one task sorts does not grow with the table; from MAX_BUCKETS on
    a sketch has that many, and :func:`refine_buckets` cuts them further."""
    return max(MIN_BUCKETS, -(-df.count() // BUCKET_ROWS))


def position(df: DataFrame, column: str) -> Column:
    """The column as a double that keeps its order: days or microseconds of dates and timestamps."""
    kind, c = df.schema[column].dataType, F.col(column)
    if isinstance(kind, T.DateType):
        c = F.unix_date(c)
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        c = F.unix_micros(c.cast("timestamp"))
    return c.cast("double")


@dataclass(frozen=True)
class Sketch:
    """What one pass over the input tells about how to spread it."""

    quantiles: dict[str, list[float]]
    missing: dict[str, float]
    nan: dict[str, float]
    groups: int
    buckets: int
    is_coarse: bool = False

    def cuts(self, column: str) -> list[float]:
        return sorted(set(self.quantiles[column]))

    def hot(self, column: str) -> dict[float, int]:
        """Values that fill a whole bucket or more, with the number of buckets they fill."""
        times = Counter(self.quantiles[column])
        return {v: n for v, n in times.items() if n > 1}


def sketch(
    df: DataFrame, columns: Sequence[str], buckets: int | None = None, by: Sequence[str] = ()
) -> Sketch:
    """Approximate quantiles of the columns and number of groups: one row to the driver, one scan. However many
    rows there are, a column has no more than MAX_BUCKETS quantiles, unless ``buckets`` asks for more."""
    target = buckets or bucket_target(df)
    n = target if buckets else min(target, MAX_BUCKETS)
    probs = [i / n for i in range(1, n)]
    # An error of a quarter bucket is enough, and keeps the sketches of many columns small.
    place = [position(df, c) for c in columns]
    aggs = [F.percentile_approx(p, probs, max(1000, 4 * n)) for p in place]
    groups = F.approx_count_distinct(F.xxhash64(*by)) if by else F.lit(1)
    gaps = [F.avg(p.isNull().cast("int")) for p in place]
    odd = [F.avg(F.coalesce(F.isnan(p), F.lit(False)).cast("int")) for p in place]
    row = df.agg(*aggs, *gaps, *odd, groups).first()
    k = len(columns)
    finite = [[v for v in (q or []) if math.isfinite(v)] for q in row[:k]]
    missing = [share or 0.0 for share in row[k : 2 * k]]
    nan = [share or 0.0 for share in row[2 * k : 3 * k]]
    return Sketch(*[dict(zip(columns, x)) for x in (finite, missing, nan)], row[-1], n, n < target)


def range_bucket(df: DataFrame, column: str, cuts: list[float], name: str = "bucket") -> DataFrame:
    """Add the index of the range a value falls in. NaN and missing values get the last two buckets."""
    last = len(cuts) + 1
    if not cuts:
        p = position(df, column)
        return df.withColumn(name, F.when(p.isNull(), last + 1).when(F.isnan(p), last).otherwise(0))
    edges = [float("-inf"), *cuts, float("inf")]
    work, raw = f"__{name}_in", f"__{name}_raw"
    df = df.withColumn(work, position(df, column))
    out = Bucketizer(inputCol=work, outputCol=raw, splits=edges, handleInvalid="keep").transform(df)
    missing = F.col(work).isNull()
    found = F.when(missing, last + 1).otherwise(F.coalesce(F.col(raw).cast("int"), F.lit(last)))
    return out.withColumn(name, found).drop(work, raw)


def refine_buckets(df: DataFrame, column: str, name: str = "bucket", by: Sequence[str] = ()) -> DataFrame:
    """Cuts buckets of far more than BUCKET_ROWS rows into FINE parts at quantiles of their own; bucket numbers change, their
    order does not. With ``by`` the buckets of each of its values are cut on their own.

    Each overfull bucket is sketched on the map side. The parts' cut points never pass the driver: they are
    broadcast, FINE numbers per overfull bucket, of which there are MAX_BUCKETS and a few at most per value of ``by``.
    """
    work, cuts, part = f"__{name}_at", f"__{name}_cuts", f"__{name}_part"
    probs = [i / FINE for i in range(1, FINE)]
    placed = df.withColumn(work, position(df, column))
    place = [*by, name]
    overfull = df.groupBy(*place).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 2 * BUCKET_ROWS).select(*place)
    inside = placed.select(*place, work).join(F.broadcast(overfull), place)
    found = inside.groupBy(*place).agg(F.percentile_approx(work, probs, 10 * FINE).alias(cuts)).filter(F.col(cuts).isNotNull())
    out = placed.join(F.broadcast(found), place, "left").withColumn(part, F.lit(0))
    step = FINE // 2
    while step:
        # The part with ``step`` more cut points below, if the last of these is below the value.
        ahead = F.get(F.col(cuts), F.col(part) + (step - 1)) < F.col(work)
        out = out.withColumn(part, F.col(part) + F.when(ahead, step).otherwise(0))
        step //= 2
    return out.withColumn(name, F.col(name).cast("bigint") * FINE + F.col(part)).drop(work, cuts, part)


def with_row_number(
    df: DataFrame, order: Sequence[str], name: str = "row_number", buckets: int | None = None
) -> DataFrame:
    """1-based position in the whole table's order, missing values last, NaN before them.

    ``order`` starts with a number, date or timestamp and must be unique as a whole for the
    numbering to be reproducible. If single values of the first column are very frequent, the second
    one, of such a type too, splits their rows further; without a second one, a hash of the row
    does, since the rows tie.
    """
    order = list(order)
    first, rest = order[0], order[1:2]
    if not rest:
        df = df.withColumn("__ties", F.xxhash64(*df.columns))
        rest = ["__ties"]
    found = sketch(df, [first, *rest], buckets)
    hot = _exact_doubles(df, first, found.hot(first))
    edges = sorted({*found.cuts(first), *hot, *[math.nextafter(v, math.inf) for v in hot]})
    spread = range_bucket(df, first, edges)
    place = ["bucket"]
    absent = math.ceil(found.missing[first] * found.buckets)
    odd = math.ceil(found.nan[first] * found.buckets)
    if hot or absent > 1 or odd > 1:
        # A value that alone would fill n buckets gets n, cut by the next order column; so do NaN
        # and the missing values, whose buckets come last.
        finer = found.cuts(rest[0])
        spread = range_bucket(spread, rest[0], finer, "finer")
        every = [*[hot.get(e, 1) for e in [None, *edges]], max(odd, 1), max(absent, 1)]
        share = F.element_at(F.expr(f"array({','.join(map(str, every))})"), F.col("bucket") + 1)
        part = F.floor(F.col("finer") * share / F.lit(len(finer) + 3))
        spread = spread.withColumn("part", part).drop("finer")
        place.append("part")
    if found.is_coarse:
        spread = refine_buckets(spread, first)
    sizes = spread.groupBy(*place).agg(F.count(F.lit(1)).alias("rows_in"))
    before = (
        Window.partitionBy(F.lit(0)).orderBy(*place).rowsBetween(Window.unboundedPreceding, -1)
    )
    # One row per bucket, hot values as many as they fill: thrice the rows over BUCKET_ROWS at most.
    base = F.broadcast(
        sizes.select(*place, F.coalesce(F.sum("rows_in").over(before), F.lit(0)).alias("rows_base"))
    )
    inside = F.row_number().over(
        Window.partitionBy(*place).orderBy(*[F.col(c).asc_nulls_last() for c in order])
    )
    return (
        spread.withColumn("__inside", inside)
        .join(base, place)
        .withColumn(name, (F.col("rows_base") + F.col("__inside")).cast("bigint"))
        .drop("bucket", "part", "rows_base", "__inside", "__ties")
    )


def _exact_doubles(df: DataFrame, column: str, values: dict[float, int]) -> dict[float, int]:
    """The values whose double form stands for one column value only."""
    kind = df.schema[column].dataType
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return values
    whole = (T.IntegralType, T.DateType, T.TimestampType, T.TimestampNTZType)
    if isinstance(kind, whole):
        return {v: n for v, n in values.items() if abs(v) < 2**53}
    if isinstance(kind, T.DecimalType) and kind.precision <= 15:
        return values
    return {}


def running_sums(
    runs: DataFrame, order: str, sums: Sequence[str], buckets: int | None = None
) -> DataFrame:
    """For one row per distinct ``order`` value, add ``<sum>_before``: the total over all smaller values."""
    sums = list(sums)
    found = sketch(runs, [order], buckets)
    spread = range_bucket(runs, order, found.cuts(order))
    if found.is_coarse:
        spread = refine_buckets(spread, order)
    totals = spread.groupBy("bucket").agg(*[F.sum(s).alias(f"{s}_in") for s in sums])
    before = (
        Window.partitionBy(F.lit(0)).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    )
    # One row per bucket: rows over BUCKET_ROWS, and a few.
    base = F.broadcast(
        totals.select(
            "bucket",
            *[F.coalesce(F.sum(f"{s}_in").over(before), F.lit(0)).alias(f"{s}_base") for s in sums],
        )
    )
    inside = (
        Window.partitionBy("bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    )
    parts = spread.withColumns({f"__{s}": F.coalesce(F.sum(s).over(inside), F.lit(0)) for s in sums})
    return (
        parts.join(base, "bucket")
        .withColumns({f"{s}_before": F.col(f"{s}_base") + F.col(f"__{s}") for s in sums})
        .drop("bucket", *[f"{s}_base" for s in sums], *[f"__{s}" for s in sums])
    )


def top_k(df: DataFrame, order: Sequence[Column | str], k: int) -> DataFrame:
    """First ``k`` rows of an order: each task keeps its own best ``k``, nothing is fully sorted."""
    return df.orderBy(*order).limit(k)


def _ranks(n: Column, p: float) -> tuple[Column, Column, Column]:
    """Zero-based ranks either side of a quantile, and the weight of the upper one."""
    h = (n - 1) * F.lit(float(p))
    low = F.floor(h)
    return low.cast("bigint"), F.ceil(h).cast("bigint"), h - low


def exact_quantiles(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    probs: Iterable[float],
    buckets: int | None = None,
    cell: str | None = None,
    groups: int | None = None,
) -> DataFrame:
    """Exact, linearly interpolated quantiles of ``value`` per group, as ``q0, q1, ...``.

    Also gives ``n``, ``lowest`` and ``highest`` of the non-missing values. Counts per (group,
    bucket) say which buckets hold the wanted ranks; only their rows are looked at again, with
    equal values merged first. So neither a huge group nor a huge tie ends up in one task.
    ``cell`` names a ready bucket column, for callers that cut each variable on its own scale;
    they also give the number of ``groups``.
    """
    by, probs = list(by), list(probs)
    present = df.filter(F.col(value).isNotNull()).withColumn(value, F.col(value).cast("double"))
    if cell is None:
        found = sketch(present, [value], buckets, by)
        groups = 2 * found.groups  # the group count is an estimate
        present = range_bucket(present.select(*by, value), value, found.cuts(value))
        if found.is_coarse:
            present = refine_buckets(present, value)
    else:
        present = present.select(*by, value, F.col(cell).alias("bucket"))
    small = groups is not None and groups * 2 * len(probs) <= BROADCAST_ROWS
    if small:
        present = present.withColumn("ties", F.lit(1).cast("bigint"))
    else:
        # Many groups: the wanted cells are too many to broadcast, so merge ties before the join.
        present = present.groupBy(*by, "bucket", value).agg(F.count(F.lit(1)).alias("ties"))

    group = Window.partitionBy(*(by or [F.lit(0)]))
    upto = group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cells = present.groupBy(*by, "bucket").agg(
        F.sum("ties").alias("rows_in"), F.min(value).alias("lo"), F.max(value).alias("hi")
    )
    placed = cells.select(
        *by,
        "bucket",
        (F.sum("rows_in").over(upto) - F.col("rows_in")).alias("rows_base"),
        "rows_in",
        F.sum("rows_in").over(group).alias("n"),
        F.min("lo").over(group).alias("lowest"),
        F.max("hi").over(group).alias("highest"),
    )
    ranks = F.array_distinct(
        F.array(*[r for p in probs for r in _ranks(F.col("n"), p)[:2]])
    )
    wanted = placed.withColumn(
        "ranks",
        F.filter(
            ranks,
            lambda r: (r >= F.col("rows_base")) & (r < F.col("rows_base") + F.col("rows_in")),
        ),
    ).filter(F.size("ranks") > 0)

    # Equality that also matches a missing group key to itself.
    left = present.alias("p")
    right = (F.broadcast(wanted) if small else wanted).alias("w")
    same = F.col("p.bucket") == F.col("w.bucket")
    for k in by:
        same = same & F.col(f"p.{k}").eqNullSafe(F.col(f"w.{k}"))
    extra = ["rows_base", "n", "lowest", "highest", "ranks"]
    ties = (
        left.join(right, same)
        .select(
            *[f"p.{k}" for k in by], "p.bucket", f"p.{value}", "p.ties", *[f"w.{e}" for e in extra]
        )
        .groupBy(*by, "bucket", value)
        .agg(F.sum("ties").alias("ties"), *[F.first(e).alias(e) for e in extra])
    )
    inside = Window.partitionBy(*by, "bucket").orderBy(value)
    first = F.col("rows_base") + F.sum("ties").over(
        inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ) - F.col("ties")
    hits = (
        ties.withColumn("first", first)
        .withColumn(
            "rank",
            F.explode(
                F.filter(
                    "ranks",
                    lambda r: (r >= F.col("first")) & (r < F.col("first") + F.col("ties")),
                )
            ),
        )
        .select(*by, "n", "lowest", "highest", "rank", value)
    )
    exprs = []
    for i, p in enumerate(probs):
        low, high, _ = _ranks(F.col("n"), p)
        exprs += [
            F.max(F.when(F.col("rank") == low, F.col(value))).alias(f"__l{i}"),
            F.max(F.when(F.col("rank") == high, F.col(value))).alias(f"__h{i}"),
        ]
    out = hits.groupBy(*by).agg(
        *[F.first(c).alias(c) for c in ("n", "lowest", "highest")], *exprs
    )
    made = [
        (
            F.col(f"__l{i}") + _ranks(F.col("n"), p)[2] * (F.col(f"__h{i}") - F.col(f"__l{i}"))
        ).alias(f"q{i}")
        for i, p in enumerate(probs)
    ]
    n = F.col("n") if by else F.coalesce("n", F.lit(0).cast("bigint")).alias("n")
    return out.select(*by, n, "lowest", "highest", *made)
