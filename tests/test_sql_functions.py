"""The functions for ``spark.sql`` against the Column functions they stand for."""

import pytest
from pyspark.sql import functions as F

from tallyframe.functions import scalar as S
from tallyframe.functions import sql
from tallyframe.operators import sampling

NAMES = ["", " ", None, "a b", "  lead", "it's \"so\"", "5% off", ".5x", ".x", "été_", "x__y..z", "A-b/c", "%", "_", "NA", "漢 字"]


@pytest.fixture(scope="module", autouse=True)
def known(spark):
    assert set(sql.register_functions(spark)) == set(sql.SCALARS)
    sql.register_functions(spark)  # again: the same names


def test_names_are_cleaned_alike(spark):
    df = spark.createDataFrame([(n,) for n in NAMES], "raw string")
    got = df.select(S.clean_level("raw").alias("a"), F.expr("clean_str(raw)").alias("b")).collect()
    assert all(r.a == r.b and r.a is not None for r in got)


def test_one_hot_tells_missing_from_its_name(spark):
    got = spark.sql("SELECT one_hot(CAST(NULL AS STRING), 'V', array('a b', NULL)) AS m, one_hot_names('V', array('a b')) AS n").first()
    assert got.m == {"V_A_B": 0, "V_NA": 1} and got.n == ["V_A_B"]


def test_numbers_of_missing_and_odd_values(spark):
    got = spark.sql(
        "SELECT recode_status('C') a, recode_status('X') b, recode_status('4') c, recode_status('?') d, recode_status(NULL) e,"
        " period_bucket(-12) f, period_bucket(-13) g, period_bucket(-49) h, period_bucket(NULL) i,"
        " sentinel_to_null(365243) j, safe_ratio(1, 0) k, safe_ratio(3, 2) l,"
        " remove_outliers_iqr(4, 1, 2) m, remove_outliers_textbook(3.5, 1, 2) n, remove_outliers_iqr(NULL, 1, 2) o"
    ).first()
    assert tuple(got) == (0, None, 4, None, None, "SHORT", "MID", "LONG", None, None, None, 1.5, None, 3.5, None)


@pytest.mark.parametrize("rate", [0.0, 0.3, 1.0, 7.25, 120.0])
def test_poisson_limits(spark, rate):
    """The two exponential functions may differ in the last bit, and so a list may end one limit later."""
    got, want = spark.sql(f"SELECT poisson_limits({rate}D) AS x").first().x, sampling.poisson_limits(rate)
    n = min(len(got), len(want))
    assert got[:n] == pytest.approx(want[:n], rel=1e-13)
    assert max(len(got), len(want)) <= n + 1 and all(1 - x < 2**-49 for x in (got + want)[-1:] + got[n:] + want[n:])


ROWS = [(i, i % 10 == 0, i * 2) for i in range(5000)] + [(7, None, 0), (None, True, 1)]


def test_sampling_equals_the_operator_on_any_names(spark):
    """Columns named like the working columns; a missing class, and a missing key of class 1."""
    df = spark.createDataFrame(ROWS, "u int, class boolean, limits int").selectExpr("u", "CAST(class AS INT) AS class", "limits AS `a ``b`")
    df.createOrReplaceTempView("odd_names")
    sql.register_sampling(spark, "odd_names", "u", "class", 0.4, 43, "drawn")
    got = spark.sql("SELECT * FROM drawn()")
    assert got.columns == df.columns
    want = sampling.poisson_upsample(df, "u", "class", 0.4, 43)
    order = lambda rows: sorted(map(tuple, rows), key=repr)
    assert order(got.collect()) == order(want.collect())
    share = got.filter("class = 1").count() / got.count()
    assert abs(share - 0.4) < 0.03
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_sampling_of_one_class_and_of_nothing(spark):
    for name, rows, kept in (("zeros", [(1, 0), (2, 0)], 2), ("ones", [(1, 1)], 0), ("nothing", [], 0)):
        spark.createDataFrame(rows, "id int, y int").createOrReplaceTempView(name)
        sql.register_sampling(spark, name, "id", "y", 0.5, 1, f"drawn_{name}")
        assert spark.sql(f"SELECT * FROM drawn_{name}()").count() == kept
