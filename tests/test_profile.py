"""Column kinds at their limits, fences, views, histograms and densities."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.operators import profile


@pytest.fixture(scope="module")
def mixed(spark):
    return spark.range(1000).select(
        "id",
        (F.col("id") % 2).alias("flag"),
        F.when(F.col("id") % 3 > 0, F.col("id") % 2).alias("flag_gap"),
        (F.col("id") % 99).alias("d99"),
        (F.col("id") % 100).alias("d100"),
        (F.col("id") % 101).alias("d101"),
        F.when(F.col("id") != 5, F.col("id") % 99).alias("d99_gap"),
        F.lit("x").alias("text"),
        (F.col("id") % 2).cast("string").alias("flag_text"),
        (F.col("id") % 2 == 0).cast("int").alias("y"),
    )


def test_column_kinds_at_the_limits(mixed):
    kinds = profile.column_kinds(mixed)
    assert {c for c, k in kinds.items() if k["dummy"]} == {"flag", "flag_text", "y"}
    assert {c for c, k in kinds.items() if k["discrete"]} == {"flag", "flag_gap", "d99", "y"}
    assert profile.columns_of_kind(kinds, "continuous", ["id"]) == ["d100", "d101", "d99_gap"]
    assert profile.select_kind(mixed, "discrete").columns == ["flag_gap", "d99"]


def test_catalogue(mixed):
    got = {r.variable_name: r for r in profile.variable_catalogue(mixed, "id", "y").collect()}
    assert got["id"].id and not got["id"].continuous
    assert got["y"].target and got["y"].dummy and not got["y"].continuous
    assert got["text"].character and got["d101"].continuous and len(got) == 10


def test_level_rates_over_many_variables(mixed):
    out = profile.level_rates(mixed, "y", ["flag", "flag_gap"]).collect()
    got = {(r.variable, r.valor): (r.n, r.rate, r.prop) for r in out}
    assert got[("flag", 0.0)] == (500, 1.0, 0.5)
    assert got[("flag", 1.0)] == (500, 0.0, 0.5)
    assert got[("flag_gap", None)][0] == 334
    long = profile.count_and_rate(mixed, "y", ["flag"]).collect()
    assert {(r.measure, r.valor, r.value, r.label, r.prop) for r in long} == {
        ("COUNT", 0.0, 500.0, 500.0, None),
        ("COUNT", 1.0, 500.0, 500.0, None),
        ("PROPORTION", 0.0, 1.0, 100.0, 0.5),
        ("PROPORTION", 1.0, 0.0, 0.0, 0.5),
    }


OUTLIERS = [1.0, 2.0, 4.0, 8.0, 16.0, 100.0, None]


@pytest.mark.parametrize("anchor, upper, kept", [("q1", 19.75, 5), ("q3", 31.25, 5)])
def test_fences(spark, anchor, upper, kept):
    df = spark.createDataFrame([(v,) for v in OUTLIERS], "v double")
    r = profile.fences(df, ["v"], anchor).first()
    assert (r.quartile_1, r.quartile_3, r.lower, r.upper) == (2.5, 14.0, 1.0, upper)
    out = profile.trim_outliers(df, "v", anchor)
    assert out.filter("v IS NOT NULL").count() == kept and out.count() == 7


def test_continuous_views(spark):
    df = spark.createDataFrame([(v, i % 2) for i, v in enumerate(OUTLIERS)], "v double, y int")
    out = profile.continuous_views(df, "y", ["v"]).collect()
    assert len(out) == 21 and {r.na_prop for r in out} == {14.0}
    trimmed = [r.value for r in out if r.view == "IQR" and r.value is not None]
    assert sorted(trimmed) == [1.0, 2.0, 4.0, 8.0, 16.0]


def test_histogram_and_density_against_brute_force(spark):
    rng = np.random.default_rng(3)
    x, y = rng.normal(10, 4, 2000), rng.integers(0, 2, 2000)
    df = spark.createDataFrame(list(zip(x.tolist(), y.tolist())), "x double, y int")
    bars = profile.class_histogram(df, "y", ["x"], bins=50).collect()
    for c in (0, 1):
        counts, _ = np.histogram(x[y == c], 50, (x.min(), x.max()))
        got = np.zeros(50)
        for r in bars:
            if r.y == c:
                got[r.bin] = r.n
        assert np.abs(got - counts).sum() <= 2  # edge rounding
    curve = profile.class_density(df, "y", ["x"], points=64).collect()
    for c in (0, 1):
        v = x[y == c]
        iqr = np.subtract(*np.quantile(v, [0.75, 0.25]))
        bw = 0.9 * min(v.std(ddof=1), iqr / 1.34) * len(v) ** -0.2
        for r in (r for r in curve if r.y == c):
            exact = np.exp(-0.5 * ((r.x - v) / bw) ** 2).sum() / (len(v) * bw * np.sqrt(2 * np.pi))
            assert r.bw == pytest.approx(bw) and r.density == pytest.approx(exact, rel=0.02, abs=1e-5)


def test_constant_column_has_a_density(spark):
    df = spark.createDataFrame([(1.0, 0)] * 5, "x double, y int")
    assert profile.class_density(df, "y", ["x"], points=3, bins=4).count() == 3


def test_profiles_of_a_kind(mixed):
    levels = profile.profile_levels(mixed, "id", "y").select("variable").distinct().collect()
    assert {r.variable for r in levels} == {"flag", "flag_gap", "d99", "text", "flag_text"}
    views = profile.profile_continuous(mixed, "id", "y").select("variable").distinct().collect()
    assert {r.variable for r in views} == {"d100", "d101", "d99_gap"}


def test_densities_of_the_three_views(spark):
    df = spark.range(400).selectExpr("CAST(id % 2 AS INT) AS y", "CAST(IF(id < 4, 10000, id % 90) AS DOUBLE) AS v", "id * 0.5 AS w")
    out = profile.view_density(df, "y", ["v", "w"], points=16, bins=16)
    assert {(r.variable, r.view) for r in out.select("variable", "view").distinct().collect()} == {
        (c, x) for c in "vw" for x in ("ORIGINAL", "IQR", "LOG")
    }
    logged = profile.class_density(df.selectExpr("y", "ln(1 + v) AS v"), "y", ["v"], 16, 16)
    got = out.filter("variable = 'v' AND view = 'LOG'").select(logged.columns)
    rows = lambda d: sorted((r.y, r.point, round(r.density, 9)) for r in d.collect())
    assert rows(got) == rows(logged)
    trimmed = profile.trim_outliers(df, "v")
    assert trimmed.columns == df.columns and trimmed.filter("v > 100").count() == 0


def test_fences_on_refined_buckets(spark, monkeypatch):
    from tallyframe.operators import ordered

    df = spark.range(2000).select((F.col("id") * 7919 % 997).alias("a"), (F.col("id") % 13).alias("b"))
    want = sorted(map(tuple, profile.fences(df, ["a", "b"]).collect()))
    for name, value in (("MIN_BUCKETS", 2), ("MAX_BUCKETS", 3), ("BUCKET_ROWS", 10)):
        monkeypatch.setattr(ordered, name, value)
    assert ordered.sketch(df, ["a"]).is_coarse
    assert sorted(map(tuple, profile.fences(df, ["a", "b"]).collect())) == want
