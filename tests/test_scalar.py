"""Scalar rules: recoding, buckets, missing values, ratios, labels, level names."""

import pytest
from pyspark.sql import functions as F

from tallyframe.functions import scalar as S


def one(spark, expr, **values):
    """Evaluate an expression over one row of typed values."""
    names = list(values)
    schema = ", ".join(f"{n} {values[n][0]}" for n in names)
    df = spark.createDataFrame([tuple(values[n][1] for n in names)], schema)
    return df.select(expr().alias("r")).first().r


LEVELS = {
    "1-URGENT": "X1_URGENT",
    "50% off": "X50PERCENT_OFF",
    "  leading": "LEADING",
    "": "X",
    "_a": "X_A",
    ".5x": "X_5X",
    "(x": "X_X",
    "it's \"q\"": "ITS_Q",
    None: "NA",
    "Cash loans (non-earmarked)": "CASH_LOANS_NON_EARMARKED",
    "a.._.b__": "A_B",
    ".ok": "_OK",
    "Ähre": "ÄHRE",
}


def test_clean_level(spark):
    df = spark.createDataFrame([(k,) for k in LEVELS], "raw string")
    got = {r.raw: r.clean for r in df.select("raw", S.clean_level("raw").alias("clean")).collect()}
    assert got == LEVELS


@pytest.mark.parametrize("raw, expected", [("C", 0), ("X", None), ("3", 3), ("?", None), (None, None)])
def test_recode_status(spark, raw, expected):
    assert one(spark, lambda: S.recode_status("s"), s=("string", raw)) == expected


@pytest.mark.parametrize(
    "offset, expected",
    [(0, "SHORT"), (-12, "SHORT"), (-13, "MID"), (-48, "MID"), (-49, "LONG"), (None, None)],
)
def test_period_bucket_and_predicates_agree(spark, offset, expected):
    assert one(spark, lambda: S.period_bucket("m"), m=("int", offset)) == expected
    for period in S.PERIODS:
        hit = one(spark, lambda: S.in_period("m", period), m=("int", offset))
        assert hit == (None if offset is None else period == expected)


@pytest.mark.parametrize(
    "a, b, expected", [(1.0, 0.0, None), (0.0, 0.0, None), (None, 2.0, None), (1.0, 4.0, 0.25)]
)
def test_safe_ratio(spark, a, b, expected):
    assert one(spark, lambda: S.safe_ratio("a", "b"), a=("double", a), b=("double", b)) == expected


@pytest.mark.parametrize("rate, label", [(0.005, 0.0), (0.015, 2.0), (0.025, 2.0), (0.1, 10.0)])
def test_percent_label_rounds_ties_to_even(spark, rate, label):
    assert one(spark, lambda: S.percent_label("r"), r=("double", rate)) == label


def test_flags_keep_missing(spark):
    assert one(spark, lambda: S.flag(F.col("a") > F.col("b")), a=("int", None), b=("int", 1)) is None
    assert one(spark, lambda: S.flag(F.col("a") > F.col("b")), a=("int", 2), b=("int", 1)) == 1
    assert [one(spark, lambda: S.truthy("a"), a=("int", v)) for v in (0, -3, None)] == [0, 1, None]


def test_prefix_sentinel_and_bounds(spark):
    assert one(spark, lambda: S.extract_prefix("t"), t=("string", "Cash-x through")) == "Cash-x"
    assert one(spark, lambda: S.extract_prefix("t"), t=("string", " x")) is None
    assert one(spark, lambda: S.sentinel_to_null("d"), d=("int", 365243)) is None
    assert one(spark, lambda: S.sentinel_to_null("d"), d=("int", -5)) == -5
    assert one(spark, lambda: S.keep_between("d", F.lit(1), F.lit(3)), d=("int", 3)) == 3
    assert one(spark, lambda: S.keep_between("d", F.lit(1), F.lit(3)), d=("int", 4)) is None
    assert one(spark, lambda: S.clamp("d", F.lit(1), F.lit(3)), d=("int", 9)) == 3
    assert one(spark, lambda: S.log1p("d"), d=("double", -2.0)) is None


def test_row_mean_and_product_propagate_missing(spark):
    full = dict(a=("double", 1.0), b=("double", 2.0), c=("double", 6.0))
    assert one(spark, lambda: S.row_mean("a", "b", "c"), **full) == 3.0
    assert one(spark, lambda: S.row_product("a", "b", "c"), **full) == 12.0
    gap = {**full, "b": ("double", None)}
    assert one(spark, lambda: S.row_mean("a", "b", "c"), **gap) is None
    assert one(spark, lambda: S.null_to_zero(S.row_product("a", "b", "c")), **gap) == 0.0
