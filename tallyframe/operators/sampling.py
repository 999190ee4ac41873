"""Seeded splitting and rebalancing.

A draw is the md5 of id and seed, so it depends on the row alone, never on partitioning, retries or
lost executors. Exact sample sizes come from a rank threshold found in a histogram of the hash:
counts per hash prefix, then the rows of the one prefix where the cut falls. Only ids, classes and
hashes are shuffled; wide rows are just filtered or joined once.

Ids must be unique. Copies of an id share its hash and stay on the same side of every split.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions import aggregates as A
from tallyframe.functions.scalar import hash_hex
from tallyframe.operators.joins import bind_rows

# Fixed values.
SEED = 42
TRAIN_FRACTION = 0.8
MINORITY_SHARE = 0.3

PREFIX_DIGITS = 4  # 65,536 evenly filled hash buckets per class
MAX_CLASSES = 1000


def _hashed(keys: DataFrame, id_col: str, *others: str, seed: int) -> DataFrame:
    return keys.select(id_col, *others, hash_hex(id_col, seed).alias("draw")).withColumn(
        "prefix", F.substring("draw", 1, PREFIX_DIGITS)
    )


def _prefix_offsets(hashed: DataFrame, *by: str) -> DataFrame:
    """Per group and prefix: rows in it, rows in all earlier prefixes, rows of the group."""
    group = Window.partitionBy(*(by or [F.lit(0)]))
    upto = group.orderBy("prefix").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        hashed.groupBy(*by, "prefix")
        .agg(A.row_count().alias("rows_in"))
        .withColumns(
            {
                "rows_base": F.sum("rows_in").over(upto) - F.col("rows_in"),
                "rows_all": F.sum("rows_in").over(group),
            }
        )
    )


def _class_rows(df: DataFrame) -> DataFrame:
    """Bring a table with one row per class to the driver and back, refusing more than MAX_CLASSES."""
    rows = df.limit(MAX_CLASSES + 1).collect()
    if len(rows) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} classes: the target is not a class label")
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


def class_thresholds(
    keys: DataFrame, id_col: str, target: str, fraction: float = TRAIN_FRACTION, seed: int = SEED
) -> DataFrame:
    """Per class, the draw and id of the last row inside the sample (no row if the sample is empty)."""
    hashed = _hashed(keys.filter(F.col(target).isNotNull()), id_col, target, seed=seed)
    cut = _class_rows(
        _prefix_offsets(hashed, target)
        .withColumn("take", F.bround(F.col("rows_all") * F.lit(float(fraction)), 0).cast("bigint"))
        .filter(
            (F.col("take") > F.col("rows_base"))
            & (F.col("take") <= F.col("rows_base") + F.col("rows_in"))
        )
        .select(target, "prefix", (F.col("take") - F.col("rows_base")).alias("nth"))
    )
    place = F.row_number().over(Window.partitionBy(target, "prefix").orderBy("draw", id_col))
    return _class_rows(
        hashed.join(cut, [target, "prefix"])
        .withColumn("place", place)
        .filter(F.col("place") == F.col("nth"))
        .select(target, F.col("draw").alias("last_draw"), F.col(id_col).alias("last_id"))
    )


def stratified_sample(
    df: DataFrame,
    id_col: str,
    target: str,
    fraction: float = TRAIN_FRACTION,
    seed: int = SEED,
    keys: DataFrame | None = None,
    name: str = "in_sample",
) -> DataFrame:
    """Flag exactly ``round(fraction * n)`` rows of each class; NULL where the class is missing.

    ``keys`` may give id and class from a cheaper table than ``df``. The thresholds are found right
    away, in two passes over the keys; flagging is then a map-side lookup.
    """
    limits = class_thresholds(
        (df if keys is None else keys).select(id_col, target), id_col, target, fraction, seed
    )
    draw = hash_hex(id_col, seed)
    within = (draw < F.col("last_draw")) | (
        (draw == F.col("last_draw")) & (F.col(id_col) <= F.col("last_id"))
    )
    return (
        df.join(limits, target, "left")
        .withColumn(
            name, F.when(F.col(target).isNotNull(), F.coalesce(within, F.lit(False)))
        )
        .select(*df.columns, name)
    )


def three_way_split(
    df: DataFrame,
    id_col: str,
    target: str,
    fraction: float = TRAIN_FRACTION,
    seed: int = SEED,
    keys: DataFrame | None = None,
    name: str = "split",
) -> DataFrame:
    """Label every row ``train``, ``validation`` or (class missing) ``test``."""
    flagged = stratified_sample(df, id_col, target, fraction, seed, keys, "__in")
    label = F.when(F.col("__in").isNull(), "test").when(F.col("__in"), "train")
    return flagged.withColumn(name, label.otherwise("validation")).drop("__in")


def class_balance(df: DataFrame, target: str) -> DataFrame:
    return df.groupBy(target).agg(A.row_count().alias("n"))


def upsample_factor_expr(target: str, share: float) -> Column:
    zeros, ones = A.count_where(F.col(target) == 0), A.count_where(F.col(target) == 1)
    return F.try_divide(F.lit(float(share)) * zeros, ones * F.lit(1 - float(share)))


def upsample_factor(df: DataFrame, target: str, share: float = MINORITY_SHARE) -> DataFrame:
    """How many times over class 1 must be drawn to make up ``share`` of the table."""
    return df.agg(
        A.count_where(F.col(target) == 0).alias("n_0"),
        A.count_where(F.col(target) == 1).alias("n_1"),
        upsample_factor_expr(target, share).alias("factor"),
    )


def indexed_by_hash(keys: DataFrame, id_col: str, seed: int = SEED) -> DataFrame:
    """0-based position of each id in hash order: offset of its prefix + place within the prefix."""
    hashed = _hashed(keys, id_col, seed=seed)
    place = F.row_number().over(Window.partitionBy("prefix").orderBy("draw", id_col))
    # One row per prefix: at most 16 ** PREFIX_DIGITS.
    offsets = F.broadcast(_prefix_offsets(hashed).select("prefix", "rows_base"))
    return (
        hashed.withColumn("place", place)
        .join(offsets, "prefix")
        .select(id_col, (F.col("rows_base") + F.col("place") - 1).alias("position"))
    )


def bootstrap_copies(
    keys: DataFrame,
    id_col: str,
    target: str,
    share: float = MINORITY_SHARE,
    seed: int = SEED,
) -> DataFrame:
    """(id, copies) for the class-1 rows drawn at least once, with replacement.

    Draw ``d`` picks the row at ``md5(d:seed) mod n_1``. Draws are counted per position before they
    meet the rows, so a position is one row however often it comes up.
    """
    sizes = upsample_factor(keys, target, share).first()  # three numbers
    n_ones = sizes["n_1"]
    if not n_ones or not sizes["n_0"]:
        raise ValueError("rebalancing needs rows of both classes")
    draws = round(n_ones * sizes["factor"])
    number = F.conv(F.substring(hash_hex("id", seed), 1, 15), 16, 10).cast("bigint")
    picked = (
        keys.sparkSession.range(draws)
        .select((number % F.lit(n_ones)).alias("position"))
        .groupBy("position")
        .agg(A.row_count().alias("copies"))
    )
    ones = indexed_by_hash(keys.filter(F.col(target) == 1), id_col, seed)
    return ones.join(picked, "position").select(id_col, "copies")


def upsample(
    df: DataFrame,
    id_col: str,
    target: str,
    share: float = MINORITY_SHARE,
    seed: int = SEED,
    keys: DataFrame | None = None,
) -> DataFrame:
    """All class-0 rows, and class-1 rows replaced by a bootstrap that makes up ``share`` of the result."""
    keys = (df if keys is None else keys).select(id_col, target)
    copies = bootstrap_copies(keys, id_col, target, share, seed)
    ones = (
        df.filter(F.col(target) == 1)
        .join(copies, id_col)
        .withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
        .select(*df.columns)
    )
    return bind_rows(df.filter(F.col(target) == 0), ones)


# ---- Poisson bootstrap: every row draws for itself


def poisson_limits(rate: float) -> list[float]:
    """P(count <= 0), P(count <= 1), ... of a Poisson count, as far as doubles tell them from 1."""
    if not 0 <= rate <= 500:
        raise ValueError("rates from 0 to 500 can be drawn")
    p = total = math.exp(-rate)
    limits, k = [total], 0
    while total < 1 - 2**-50 and k < 10 * rate + 100:
        k += 1
        p = p * rate / k
        total += p
        limits.append(total)
    return limits


def poisson_count(key: Column | str, rate: float, seed: int = SEED) -> Column:
    """A Poisson count of mean ``rate``, from the hash of key and seed: how many limits lie at or below a uniform draw."""
    uniform = F.conv(F.substring(hash_hex(key, seed), 1, 13), 16, 10).cast("bigint").cast("double") / F.lit(float(1 << 52))
    limits = F.array(*[F.lit(x) for x in poisson_limits(rate)])
    return F.size(F.filter(limits, lambda x: x <= uniform)).cast("bigint")


def poisson_upsample(
    df: DataFrame, id_col: str, target: str, share: float = MINORITY_SHARE, seed: int = SEED + 1, keys: DataFrame | None = None
) -> DataFrame:
    """All class-0 rows, and class-1 rows each as often as its own Poisson draw says, so that they make up ``share`` of the
    result on average. One pass: no table of draws, no numbering of rows, no join.

    The number of class-1 rows varies by about its square root around the exact bootstrap's."""
    factor = upsample_factor(df if keys is None else keys, target, share).first()["factor"]  # three numbers
    if not factor:
        raise ValueError("rebalancing needs rows of both classes")
    copies = F.when(F.col(target) == 0, 1).when(F.col(target) == 1, poisson_count(id_col, factor, seed)).otherwise(0)
    rows = df.select(F.struct("*").alias("__row"), copies.cast("int").alias("__copies")).filter("__copies > 0")
    return rows.select("__row", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select("__row.*")
