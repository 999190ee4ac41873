"""Scalar column expressions. All are built-in Spark expressions, so they stay in generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
MISSING_DAY = 365243
SHORT_FROM = -12
MID_FROM = -48
PERIODS = ("SHORT", "MID", "LONG")
CLOSED_STATUS = "C"
UNKNOWN_STATUS = "X"
LEADING_TOKEN = r"^[\w\-]+"


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_level(c: Column | str) -> Column:
    """Turn a category level into an upper-case column-name part; a missing level becomes ``NA``."""
    text = F.coalesce(as_col(c).cast("string"), F.lit("NA"))
    text = F.regexp_replace(text, "['\"]", "")
    text = F.replace(text, F.lit("%"), F.lit("percent"))
    text = F.regexp_replace(text, "^ +", "")
    # A name may not be empty, nor start with anything but a letter or a dot not followed by a digit.
    needs_prefix = (text == "") | text.rlike(r"^([^\p{L}.]|[.][0-9])")
    text = F.when(needs_prefix, F.concat(F.lit("X"), text)).otherwise(text)
    text = F.regexp_replace(text, r"[^\p{L}0-9._]", ".")
    text = F.regexp_replace(text, r"[._]+", "_")
    return F.upper(F.regexp_replace(text, "_$", ""))


def level_name(variable: str, c: Column | str) -> Column:
    return F.concat(F.lit(f"{variable}_"), clean_level(c))


def extract_prefix(c: Column | str, pattern: str = LEADING_TOKEN) -> Column:
    """First match of ``pattern``; NULL, not the empty string, when there is none."""
    return F.nullif(F.regexp_extract(as_col(c), pattern, 0), F.lit(""))


def period_bucket(
    offset: Column | str, short_from: int = SHORT_FROM, mid_from: int = MID_FROM
) -> Column:
    """SHORT / MID / LONG by how far back the (non-positive) offset lies; NULL stays NULL."""
    o = as_col(offset)
    return F.when(o >= short_from, "SHORT").when(o >= mid_from, "MID").when(o.isNotNull(), "LONG")


def in_period(
    offset: Column | str, period: str, short_from: int = SHORT_FROM, mid_from: int = MID_FROM
) -> Column:
    """Predicate form of :func:`period_bucket`, so that one-pass pivots compare numbers, not text."""
    o = as_col(offset)
    return {
        "SHORT": o >= short_from,
        "MID": (o >= mid_from) & (o < short_from),
        "LONG": o < mid_from,
    }[period]


def sentinel_to_null(c: Column | str, sentinel=MISSING_DAY) -> Column:
    return F.nullif(as_col(c), F.lit(sentinel))


def recode_status(c: Column | str) -> Column:
    """Closed counts as 0, unknown as missing, anything else as its number."""
    s = as_col(c)
    return (
        F.when(s == CLOSED_STATUS, F.lit(0))
        .when(s == UNKNOWN_STATUS, F.lit(None))
        .otherwise(s.try_cast("int"))
    )


def truthy(c: Column | str) -> Column:
    """1 for any non-zero number, 0 for zero, NULL for missing."""
    return (as_col(c) != 0).cast("int")


def flag(condition: Column) -> Column:
    """Three-valued condition as 1 / 0 / NULL."""
    return condition.cast("int")


def safe_ratio(numerator: Column | str, denominator: Column | str) -> Column:
    """Quotient as double; NULL where the divisor is zero or either side is missing."""
    return F.try_divide(as_col(numerator).cast("double"), as_col(denominator).cast("double"))


def row_mean(*cols: Column | str) -> Column:
    return reduce(lambda a, b: a + b, map(as_col, cols)) / F.lit(len(cols))


def row_product(*cols: Column | str) -> Column:
    return reduce(lambda a, b: a * b, map(as_col, cols))


def null_to_zero(c: Column | str) -> Column:
    return F.coalesce(as_col(c), F.lit(0))


def is_missing(c: Column | str, floating: bool = False) -> Column:
    col = as_col(c)
    return col.isNull() | F.isnan(col) if floating else col.isNull()


def percent_label(rate: Column | str, digits: int = 0) -> Column:
    """Rate as a percentage, ties rounded to the even neighbour."""
    return F.bround(as_col(rate) * 100, digits)


def log1p(c: Column | str) -> Column:
    return F.log1p(as_col(c))


def clamp(c: Column | str, low: Column | str, high: Column | str) -> Column:
    return F.least(F.greatest(as_col(c), as_col(low)), as_col(high))


def keep_between(c: Column | str, low: Column | str, high: Column | str) -> Column:
    """The value where it lies within both (inclusive) bounds, else NULL."""
    col = as_col(c)
    return F.when(col.between(as_col(low), as_col(high)), col)


def hash_hex(key: Column | str, seed: int) -> Column:
    """Uniform hex text of a key and a seed: the same on any partitioning, cluster or engine."""
    return F.md5(F.concat_ws(":", as_col(key).cast("string"), F.lit(str(seed))))
