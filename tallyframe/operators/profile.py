"""Column classification, target-rate profiles, outlier trimming, histograms and densities.

Every profile covers all chosen variables in one job: values are brought to long form inside the
scan stage and combined there, so the cost is one scan however many variables there are.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.functions import aggregates as A
from tallyframe.functions.scalar import keep_between, percent_label
from tallyframe.operators import ordered, reshape, selectors
from tallyframe.operators.aggregate import strict_rate

# Fixed values.
DISCRETE_BELOW = 100
FENCE_FACTOR = 1.5
DENSITY_POINTS = 512

# Small distinct counts are estimated almost exactly; estimates near the limit are counted anyway.
_SURELY_DISCRETE = 0.8
_SURELY_MANY = 1.25


def column_kinds(df: DataFrame, columns: Iterable[str] | None = None) -> dict[str, dict]:
    """Per column: dummy (all values 0/1), discrete (numeric, under 100 distinct), character, numeric.

    One aggregate over the table answers nearly everything; columns whose distinct estimate is close
    to the limit are counted exactly in one more job. A missing value counts as a distinct value,
    and keeps a column from being a dummy.
    """
    columns = list(columns) if columns is not None else df.columns
    return _kinds_from(df, columns, df.agg(*_kind_aggs(df, columns)).first().asDict())


def _kind_aggs(df: DataFrame, columns: list[str]) -> list[Column]:
    numeric = set(selectors.numeric(df)) & set(columns)
    text = set(selectors.character(df)) & set(columns)
    aggs = []
    for i, c in enumerate(columns):
        if c in numeric:
            zero_one = F.col(c).isin(0, 1)
        elif c in text:
            zero_one = F.col(c).isin("0", "1")
        elif isinstance(df.schema[c].dataType, T.BooleanType):
            zero_one = F.col(c).isNotNull()
        else:
            zero_one = F.lit(False)
        every = F.bool_and(F.coalesce(zero_one, F.lit(False)))
        aggs.append(F.coalesce(every, F.lit(True)).alias(f"z{i}"))
        if c in numeric:
            # The hash of a missing value is a value, so the sketch counts it as one.
            seen = F.hll_sketch_agg(F.xxhash64(c))
            aggs.append(F.coalesce(F.hll_sketch_estimate(seen), F.lit(0)).alias(f"d{i}"))
    return aggs


def _kinds_from(df: DataFrame, columns: list[str], row: dict) -> dict[str, dict]:
    """Kinds from the aggregates' values; ``df`` is read again only for columns close to the limit."""
    numeric = set(selectors.numeric(df)) & set(columns)
    text = set(selectors.character(df)) & set(columns)
    kinds, unsure = {}, []
    for i, c in enumerate(columns):
        distinct = row[f"d{i}"] if c in numeric else None
        if distinct is not None and (
            DISCRETE_BELOW * _SURELY_DISCRETE <= distinct <= DISCRETE_BELOW * _SURELY_MANY
        ):
            unsure.append(c)
        kinds[c] = {
            "dummy": row[f"z{i}"],
            "discrete": distinct is not None and distinct < DISCRETE_BELOW,
            "character": c in text,
            "numeric": c in numeric,
        }
    if unsure:
        long = df.select(*[F.col(c).cast("double").alias(c) for c in unsure]).select(
            F.inline(
                F.array(
                    *[F.struct(F.lit(c).alias("variable"), F.col(c).alias("valor")) for c in unsure]
                )
            )
        )
        exact = long.distinct().groupBy("variable").agg(A.row_count().alias("n")).collect()
        for r in exact:
            kinds[r.variable]["discrete"] = r.n < DISCRETE_BELOW
    return kinds


def columns_of_kind(kinds: dict[str, dict], kind: str, exclude: Iterable[str] = ()) -> list[str]:
    """Names of ``dummy`` columns, of ``discrete`` ones that are no dummies, or of ``continuous`` ones."""
    skip = set(exclude)
    tests = {
        "dummy": lambda k: k["dummy"],
        "discrete": lambda k: k["discrete"] and not k["dummy"],
        "continuous": lambda k: k["numeric"] and not k["discrete"] and not k["dummy"],
        "character": lambda k: k["character"],
    }
    return [c for c, k in kinds.items() if c not in skip and tests[kind](k)]


def select_kind(df: DataFrame, kind: str, exclude: Iterable[str] = ()) -> DataFrame:
    return df.select(*columns_of_kind(column_kinds(df), kind, exclude))


def variable_catalogue(df: DataFrame, id_col: str, target: str) -> DataFrame:
    """One row per column of the table, with a flag for each kind."""
    rows = []
    for c, k in column_kinds(df).items():
        is_id, is_target = c == id_col, c == target
        plain = not (is_id or is_target or k["dummy"] or k["discrete"] or k["character"])
        rows.append((c, is_id, is_target, k["dummy"], k["discrete"], k["character"], plain))
    schema = (
        "variable_name string, id boolean, target boolean, dummy boolean, discrete boolean,"
        " character boolean, continuous boolean"
    )
    return df.sparkSession.createDataFrame(rows, schema)


def level_rates(df: DataFrame, target: str, variables: Sequence[str]) -> DataFrame:
    """Count, target rate, overall rate and percent label of every (variable, level), in one job."""
    variables = selectors.one_of(df, variables)
    texts = {f.name for f in df.schema if isinstance(f.dataType, T.StringType)} & set(variables)
    kind = "string" if texts else "double"
    long = df.select(
        F.col(target).alias("__target"),
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(v).alias("variable"), F.col(v).cast(kind).alias("valor"))
                    for v in variables
                ]
            )
        ),
    )
    counts = long.groupBy("variable", "valor").agg(
        A.row_count().alias("n"),
        F.sum("__target").alias("positives"),
        F.count("__target").alias("known"),
    )
    # Every variable covers all rows, so any one of them gives the overall rate; no filter, so that
    # the subquery reuses the shuffle of the counts.
    first = F.col("variable") == variables[0]
    overall = counts.agg(
        strict_rate(*[F.sum(F.when(first, F.col(c))) for c in ("positives", "known", "n")])
    ).scalar()
    return counts.select(
        "variable",
        "valor",
        "n",
        overall.alias("prop"),
        strict_rate(F.col("positives"), F.col("known"), F.col("n")).alias("rate"),
    ).withColumn("label", percent_label("rate"))


def count_and_rate(df: DataFrame, target: str, variables: Sequence[str]) -> DataFrame:
    """Long form of :func:`level_rates`: a COUNT row and a PROPORTION row per (variable, level)."""
    wide = level_rates(df, target, variables).withColumnsRenamed({"n": "COUNT", "rate": "PROPORTION"})
    rows = F.array(
        F.struct(
            F.lit("COUNT").alias("measure"),
            F.col("COUNT").cast("double").alias("value"),
            F.col("COUNT").cast("double").alias("label"),
            F.lit(None).cast("double").alias("prop"),
        ),
        F.struct(
            F.lit("PROPORTION").alias("measure"),
            F.col("PROPORTION").alias("value"),
            F.col("label"),
            F.col("prop"),
        ),
    )
    return wide.select("variable", "valor", F.inline(rows))


def profile_levels(df: DataFrame, id_col: str, target: str) -> DataFrame:
    """Count and target rate of every level of every dummy, discrete or text column, in one job."""
    kinds = column_kinds(df)
    names = [
        c
        for c, k in kinds.items()
        if c not in (id_col, target) and (k["dummy"] or k["discrete"] or k["character"])
    ]
    return count_and_rate(df, target, names)


def profile_continuous(
    df: DataFrame, id_col: str, target: str, upper_anchor: str = "q1"
) -> DataFrame:
    """The three views of every continuous column, in one job."""
    names = columns_of_kind(column_kinds(df), "continuous", exclude=[id_col, target])
    return continuous_views(df, target, names, [id_col], upper_anchor)


def missing_shares(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing-value percentage of each column, long form, from one aggregate."""
    row = df.agg(*[A.missing_share(c).alias(c) for c in selectors.one_of(df, columns)])
    return row.unpivot([], list(columns), "variable", "na_prop")


def cells_long(
    df: DataFrame, variables: Sequence[str], keep: Sequence[str] = (), buckets: int | None = None
) -> tuple[DataFrame, int]:
    """(keep..., variable, valor, bucket) with each variable cut into ranges on its own scale.

    Also gives an upper estimate of the number of (keep..., variable) groups. Each variable has as
    many buckets as the rows ask for.
    """
    found = ordered.sketch(df, variables, buckets, keep)
    for i, v in enumerate(variables):
        df = ordered.range_bucket(df, v, found.cuts(v), f"__b{i}")
    long = df.select(
        *keep,
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(v).alias("variable"),
                        F.col(v).cast("double").alias("valor"),
                        F.col(f"__b{i}").alias("bucket"),
                    )
                    for i, v in enumerate(variables)
                ]
            )
        ),
    )
    if found.is_coarse:
        long = ordered.refine_buckets(long, "valor", by=["variable"])
    return long, 2 * found.groups * len(variables)


def fences(
    df: DataFrame, variables: Sequence[str], upper_anchor: str = "q1", buckets: int | None = None
) -> DataFrame:
    """Per variable, the outlier fences clipped to the data range, with the quartiles and bounds.

    ``upper_anchor="q1"`` measures the upper fence from the lower quartile, as the original recipe
    does; ``"q3"`` is the textbook rule.
    """
    long, groups = cells_long(df, variables, buckets=buckets)
    quartiles = ordered.exact_quantiles(
        long, ["variable"], "valor", [0.25, 0.75], cell="bucket", groups=groups
    )
    spread = FENCE_FACTOR * (F.col("q1") - F.col("q0"))
    anchor = {"q1": F.col("q0"), "q3": F.col("q1")}[upper_anchor]
    return quartiles.select(
        "variable",
        "n",
        "lowest",
        "highest",
        F.col("q0").alias("quartile_1"),
        F.col("q1").alias("quartile_3"),
        F.greatest("lowest", F.col("q0") - spread).alias("lower"),
        F.least("highest", anchor + spread).alias("upper"),
    )


def trim_outliers(
    df: DataFrame, column: str, upper_anchor: str = "q1", name: str | None = None
) -> DataFrame:
    """Values outside the fences become missing."""
    # One subquery for both limits, so that the quantiles are planned once. At most one row.
    ends = fences(df, [column], upper_anchor).select(F.struct("lower", "upper")).scalar()
    trimmed = df.withColumn("__ends", ends)
    value = keep_between(F.col(column).cast("double"), F.col("__ends.lower"), F.col("__ends.upper"))
    return trimmed.withColumn(name or column, value).drop("__ends")


def continuous_views(
    df: DataFrame,
    target: str,
    columns: Sequence[str],
    keep: Sequence[str] = (),
    upper_anchor: str = "q1",
) -> DataFrame:
    """Long form of each column as it is, trimmed (``IQR``) and logged (``LOG``), with its missing share."""
    columns = selectors.one_of(df, columns)
    limits = F.broadcast(fences(df, columns, upper_anchor))  # one row per column
    shares = F.broadcast(missing_shares(df, columns))  # one row per column
    base = reshape.gather(
        df.select(*keep, target, *[F.col(c).cast("double").alias(c) for c in columns]), columns
    )
    views = F.array(
        *[
            F.struct(F.lit(view).alias("view"), value.alias("value"))
            for view, value in {
                "ORIGINAL": F.col("valor"),
                "IQR": keep_between("valor", "lower", "upper"),
                "LOG": F.log1p("valor"),
            }.items()
        ]
    )
    return (
        base.join(limits, "variable", "left")
        .join(shares, "variable")
        .select(
            *keep,
            target,
            "variable",
            F.inline(views),
            F.bround("na_prop", 0).alias("na_prop"),
        )
    )


def view_density(
    df: DataFrame,
    target: str,
    columns: Sequence[str],
    upper_anchor: str = "q1",
    points: int = DENSITY_POINTS,
    bins: int = DENSITY_POINTS,
) -> DataFrame:
    """Density per class of each column as it is, trimmed (``IQR``) and logged (``LOG``).

    What charts of the three views draw, without their rows: at most ``points`` rows per column,
    view and class.
    """
    columns = selectors.one_of(df, columns)
    # One row per column.
    limits = {r["variable"]: (r["lower"], r["upper"]) for r in fences(df, columns, upper_anchor).collect()}
    views = {}
    for i, c in enumerate(columns):
        value, (low, high) = F.col(c).cast("double"), limits.get(c, (None, None))
        ends = F.lit(low).cast("double"), F.lit(high).cast("double")
        views[f"{i}_ORIGINAL"], views[f"{i}_IQR"] = value, keep_between(value, *ends)
        views[f"{i}_LOG"] = F.log1p(value)
    wide = df.select(F.col(target), *[v.alias(n) for n, v in views.items()])
    out = class_density(wide, target, list(views), points, bins)
    names = F.array(*[F.lit(c) for c in columns])
    at = F.split("variable", "_")
    return out.withColumns(
        {"view": at[1], "variable": F.element_at(names, at[0].cast("int") + 1)}
    )


def _bin(value: Column, low: Column, high: Column, bins: int) -> Column:
    width = (high - low) / F.lit(float(bins))
    raw = F.when(width > 0, F.floor((value - low) / F.nullif(width, F.lit(0.0)))).otherwise(0)
    return F.least(raw, F.lit(bins - 1)).cast("int")


def _class_moments(long: DataFrame, keys: Sequence[str]) -> DataFrame:
    return long.groupBy(*keys).agg(
        F.stddev_samp("valor").alias("sd"), F.min("valor").alias("lo"), F.max("valor").alias("hi")
    )


def class_histogram(
    df: DataFrame,
    target: str,
    variables: Sequence[str],
    bins: int = DENSITY_POINTS,
    moments: DataFrame | None = None,
) -> DataFrame:
    """Rows per (variable, class, equal-width bin over the variable's whole range)."""
    variables = selectors.one_of(df, variables)
    long = reshape.gather(
        df.select(target, *[F.col(v).cast("double").alias(v) for v in variables]), variables
    )
    if moments is None:
        moments = _class_moments(long, ["variable", target])
    ends = moments.groupBy("variable").agg(F.min("lo").alias("low"), F.max("hi").alias("high"))
    return (
        long.filter(F.col("valor").isNotNull())
        .join(F.broadcast(ends), "variable")  # one row per variable
        .groupBy(
            "variable",
            target,
            _bin(F.col("valor"), F.col("low"), F.col("high"), bins).alias("bin"),
        )
        .agg(A.row_count().alias("n"), F.first("low").alias("low"), F.first("high").alias("high"))
    )


def class_density(
    df: DataFrame,
    target: str,
    variables: Sequence[str],
    points: int = DENSITY_POINTS,
    bins: int = DENSITY_POINTS,
    buckets: int | None = None,
) -> DataFrame:
    """Gaussian density of each variable per class, on a grid over the variable's whole range.

    The kernel runs over histogram bins, not rows: every (variable, class) has at most ``bins`` of
    them, held as one array, so smoothing costs the same whatever the number of rows. Bandwidth is
    ``0.9 * min(sd, IQR / 1.34) * n ** -0.2``.
    """
    variables = selectors.one_of(df, variables)
    keys = ["variable", target]
    long, groups = cells_long(df, variables, [target], buckets)
    quartiles = ordered.exact_quantiles(
        long, keys, "valor", [0.25, 0.75], cell="bucket", groups=groups
    )
    moments = _class_moments(
        reshape.gather(
            df.select(target, *[F.col(v).cast("double").alias(v) for v in variables]), variables
        ),
        keys,
    )
    spread = F.least(
        F.when(F.col("sd") > 0, F.col("sd")),
        F.when(F.col("q1") > F.col("q0"), (F.col("q1") - F.col("q0")) / F.lit(1.34)),
    )
    bandwidth = F.lit(0.9) * F.coalesce(spread, F.lit(1.0)) * F.pow(F.col("n"), F.lit(-0.2))
    width = (F.col("high") - F.col("low")) / F.lit(float(bins))
    binned = (
        class_histogram(df, target, variables, bins, moments)
        .groupBy(*keys)
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct(
                        (F.col("low") + (F.col("bin") + F.lit(0.5)) * width).alias("mid"),
                        F.col("n").cast("double").alias("w"),
                    )
                )
            ).alias("bars"),
            F.sum("n").alias("total"),
            F.first("low").alias("low"),
            F.first("high").alias("high"),
        )
    )
    step = (F.col("high") - F.col("low")) / F.lit(float(points - 1))
    scaled = F.col("total") * F.col("bw") * F.lit(math.sqrt(2 * math.pi))

    def density_at(x: Column) -> Column:
        return F.aggregate(
            "bars",
            F.lit(0.0),
            lambda acc, bar: acc
            + bar["w"] * F.exp(F.lit(-0.5) * F.pow((x - bar["mid"]) / F.col("bw"), F.lit(2.0))),
        )

    grid = F.transform(
        F.sequence(F.lit(0), F.lit(points - 1)),
        lambda g: F.struct(
            g.alias("point"),
            (F.col("low") + g * step).alias("x"),
            (density_at(F.col("low") + g * step) / scaled).alias("density"),
        ),
    )
    same = [F.col(f"b.{k}").eqNullSafe(F.col(f"m.{k}")) for k in keys]
    same_q = [F.col(f"b.{k}").eqNullSafe(F.col(f"q.{k}")) for k in keys]
    return (
        binned.alias("b")
        .join(quartiles.alias("q"), same_q)
        .join(moments.alias("m"), same)
        .select(
            *[f"b.{k}" for k in keys], "b.bars", "b.total", "b.low", "b.high", bandwidth.alias("bw")
        )
        .select(*keys, "bw", F.inline(grid))
    )


@dataclass(frozen=True)
class Observed:
    """A table as written, and what was seen on the way: rows, kinds and missing percentages of the columns, checks."""

    table: DataFrame
    n_rows: int
    kinds: dict[str, dict]
    missing: dict[str, float | None]
    checks: dict[str, int]


def write_observed(df: DataFrame, path: str, checks: Mapping[str, Column] | None = None) -> Observed:
    """Writes ``df`` and profiles it in the same pass: column kinds, missing shares and counts of rows that meet a condition are
    metrics observed on the rows being written. Only a column whose distinct count is close to the limit is read
    again, from the written files."""
    checks = dict(checks or {})
    metrics = [A.row_count().alias("n"), *_kind_aggs(df, df.columns)]
    metrics += [F.count(F.col(f"`{c}`")).alias(f"m{i}") for i, c in enumerate(df.columns)]
    metrics += [A.count_where(condition).alias(f"c{i}") for i, condition in enumerate(checks.values())]
    seen = Observation()
    df.observe(seen, *metrics).write.mode("overwrite").parquet(path)
    got = seen.get
    table = df.sparkSession.read.parquet(path)
    n = got["n"]
    missing = {c: 100 * (n - got[f"m{i}"]) / n if n else None for i, c in enumerate(df.columns)}
    return Observed(table, n, _kinds_from(table, df.columns, got), missing, {c: got[f"c{i}"] for i, c in enumerate(checks)})
