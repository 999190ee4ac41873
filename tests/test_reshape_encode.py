"""Pivots, unpivots, key building and one-hot encoding."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tallyframe.functions import scalar as S
from tallyframe.operators import encode, reshape


def rows(df, *order):
    return sorted(tuple(r) for r in df.select(*order).collect())


def test_spread_null_and_fill(spark):
    df = spark.createDataFrame(
        [(1, "a", 10), (1, "b", None), (2, "a", 20)], "id int, k string, v int"
    )
    assert rows(reshape.spread(df, "k", "v"), "id", "a", "b") == [(1, 10, None), (2, 20, None)]
    assert rows(reshape.spread(df, "k", "v", fill=0), "id", "a", "b") == [(1, 10, 0), (2, 20, 0)]


def test_spread_refuses_duplicate_cells(spark):
    df = spark.createDataFrame([(1, "a", 10), (1, "a", 11)], "id int, k string, v int")
    with pytest.raises(PySparkException, match="several rows for one cell"):
        reshape.spread(df, "k", "v").collect()


def test_spread_multiple(spark):
    df = spark.createDataFrame(
        [(1, "a", "x", 1, 2), (1, "b", "x", 3, 4)], "id int, k1 string, k2 string, v int, w int"
    )
    out = reshape.spread_multiple(df, ["k1", "k2"], ["v", "w"])
    assert out.columns == ["id", "a_x_v", "a_x_w", "b_x_v", "b_x_w"]
    assert tuple(out.first()) == (1, 1, 2, 3, 4)
    single = reshape.spread_multiple(df.drop("w"), ["k1", "k2"], ["v"])
    assert single.columns == ["id", "a_x", "b_x"]


def test_unite_reads_missing_parts_as_text(spark):
    df = spark.createDataFrame([("a", None)], "x string, y string")
    assert reshape.unite(df, "xy", ["x", "y"]).columns == ["xy"]
    assert reshape.unite(df, "xy", ["x", "y"], remove=False).first().xy == "a_NA"


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    st.dictionaries(
        st.integers(0, 50), st.tuples(st.none() | st.integers(-9, 9), st.integers(-9, 9)), min_size=1
    )
)
def test_gather_then_spread_is_identity(spark, table):
    data = [(i, a, b) for i, (a, b) in table.items()]
    df = spark.createDataFrame(data, "id int, a int, b int")
    back = reshape.spread(reshape.gather(df, ["a", "b"]), "variable", "valor", ["a", "b"])
    assert {tuple(r) for r in back.select("id", "a", "b").collect()} == set(data)


def test_period_pivot_names_and_fill(spark):
    df = spark.createDataFrame([(1, -1, 5), (1, -20, 7), (2, -99, 1)], "id int, m int, v int")
    periods = {p: S.in_period("m", p) for p in S.PERIODS}
    out = reshape.period_pivot(
        df, ["id"], periods, {"T": lambda c: F.sum(F.when(c, F.col("v")))}, fill=0
    )
    assert rows(out, "id", "T_SHORT", "T_MID", "T_LONG") == [(1, 5, 7, 0), (2, 0, 0, 1)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


LEVELS = [("Cash loans",), ("cash.loans",), ("1-x",), (None,), ("1-x",)]


def test_one_hot_merges_levels_that_clean_alike_and_rows_sum_to_one(spark):
    df = spark.createDataFrame(LEVELS, "c string")
    out = encode.one_hot_named(df, ["c"])
    assert sorted(out.columns) == ["c_CASH_LOANS", "c_NA", "c_X1_X"]
    assert all(sum(r) == 1 for r in out.collect())
    total = out.agg(*[F.sum(c).alias(c) for c in out.columns]).first().asDict()
    assert total == {"c_CASH_LOANS": 2, "c_NA": 1, "c_X1_X": 2}


def test_level_spec_round_trip_and_unseen_levels(spark):
    df = spark.createDataFrame(LEVELS, "c string")
    spec = encode.LevelSpec.from_json(encode.resolve_levels(df, ["c"]).to_json())
    other = spark.createDataFrame([("never seen",), ("1-x",)], "c string")
    out = encode.one_hot_named(other, ["c"], spec)
    assert sorted(out.columns) == ["c_CASH_LOANS", "c_NA", "c_X1_X"]
    assert rows(out, *sorted(out.columns)) == [(0, 0, 0), (0, 0, 1)]


def test_one_hot_plain(spark):
    df = spark.createDataFrame([("A",), ("B",), (None,)], "c string")
    out = encode.one_hot_plain(df, "c")
    assert out.columns == ["A", "B"]
    assert {tuple(r) for r in out.collect()} == {(1, 0), (0, 1), (None, None)}


def test_too_many_levels_is_an_error_not_a_cut(spark):
    df = spark.range(30).select(F.col("id").cast("string").alias("a"), F.lit("x").alias("b"))
    with pytest.raises(ValueError, match="more than 20 levels"):
        encode.resolve_levels(df, ["a", "b"], max_levels=20)
    with pytest.raises(ValueError, match="more than 20 values"):
        reshape.key_values(df, "a", max_levels=20)


def test_level_counts(spark):
    df = spark.createDataFrame([(1, "x"), (1, "y"), (2, None)], "id int, c string")
    out = encode.level_counts(df, ["id"], ["c"])
    assert rows(out, "id", "c_NA", "c_X", "c_Y") == [(1, 0, 1, 1), (2, 1, 0, 0)]


def test_level_names_that_clash(spark):
    df = spark.createDataFrame([("b_c", "c", 1), ("b_c", "d", 2), ("x", "c", 3)], "A string, A_B string, A_X int")
    out = encode.one_hot_named(df, ["A", "A_B"])
    assert out.columns == ["A_X", "A_B_C", "A_X_2", "A_B_C_2", "A_B_D"]
    assert [tuple(r) for r in out.orderBy("A_X").collect()] == [(1, 1, 0, 1, 0), (2, 1, 0, 0, 1), (3, 0, 1, 1, 0)]
    counts = encode.level_counts(df.withColumn("k", F.lit(1)).drop("A_X"), ["k"], ["A", "A_B"]).first()
    assert counts.asDict() == {"k": 1, "A_B_C": 2, "A_X": 1, "A_B_C_2": 2, "A_B_D": 1}
    with pytest.raises(ValueError):
        encode.one_hot_named(df, ["A", "A_B"], max_levels=1)


def test_pivot_key_with_missing_and_the_text_na(spark):
    df = spark.createDataFrame([(1, None, 1), (1, "NA", 2)], "id int, k string, v int")
    with pytest.raises(ValueError, match="NA"):
        reshape.spread(df, "k", "v")
