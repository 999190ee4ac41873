"""Aggregates over full, part-missing and all-missing groups; fan-outs; frequency tables; rates."""

import pytest
from pyspark.sql import functions as F

from tallyframe.functions import aggregates as A
from tallyframe.operators import aggregate, joins, selectors

GROUPS = [("full", 1.0), ("full", 3.0), ("part", 5.0), ("part", None), ("none", None), ("none", None)]


@pytest.fixture
def groups(spark):
    return spark.createDataFrame(GROUPS, "k string, v double")


def by_key(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


def test_missing_rules(groups):
    got = by_key(
        groups.groupBy("k").agg(
            A.max_skip("v"), A.sum_skip("v"), A.mean_skip("v"), A.strict_sum("v"), A.strict_mean("v"),
            A.strict_max("v"), A.strict_min("v"), A.missing_share("v"),
        )
    )
    assert got == {
        "full": (3.0, 4.0, 2.0, 4.0, 2.0, 3.0, 1.0, 0.0),
        "part": (5.0, 5.0, 5.0, None, None, None, None, 50.0),
        "none": (None, 0.0, None, None, None, None, None, 100.0),
    }


def test_conditional_aggregates(groups):
    big = F.col("v") >= 3
    got = by_key(groups.groupBy("k").agg(A.count_where(big), A.max_where(big, "v")))
    assert got == {"full": (1, 3.0), "part": (1, 5.0), "none": (0, None)}


def test_fan_out_names_and_keys(groups):
    df = groups.withColumn("w", F.lit(2))
    out = aggregate.fan_out_numeric(df, ["k"], aggregate.FIVE_FUNCTIONS)
    assert out.columns[:6] == ["k", "v_N", "v_MAX_BUREAU", "v_MIN_BUREAU", "v_SUM_BUREAU", "v_MEAN_BUREAU"]
    assert aggregate.sum_all(df, ["k"], exclude=["w"]).columns == ["k", "v"]
    assert by_key(aggregate.fan_out_all(df, ["k"], aggregate.SUM_COUNT))["none"] == (0.0, 2, 4, 2)


def test_frequency_table_with_missing_level(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "x string")
    got = by_key(aggregate.frequency_table(df, "x", digits=2))
    assert got == {"a": (2, 0.5, 0.67), "b": (1, 0.25, 0.33), None: (1, 0.25, None)}


def test_rate_by_level(spark):
    df = spark.createDataFrame([("a", 1), ("a", 0), ("b", 0), ("b", None)], "x string, y int")
    got = by_key(aggregate.rate_by_level(df, "y", "x"))
    # A missing target makes its level's rate missing, and the overall one.
    assert got == {"a": (None, 2, 0.5, 50.0), "b": (None, 2, None, None)}
    known = by_key(aggregate.rate_by_level(df.filter("y IS NOT NULL"), "y", "x"))
    assert known == {"a": (1 / 3, 2, 0.5, 50.0), "b": (1 / 3, 1, 0.0, 0.0)}


def test_exact_sums_do_not_depend_on_partitions(spark):
    df = spark.range(20_000).selectExpr("id % 50 AS k", "(id * 7919 % 100003) * 1.07 * (1 - (id % 10) / 100D) AS v")
    few, many = (
        by_key(aggregate.fan_out(df.repartition(n), ["k"], ["v"], aggregate.EXACT_SUM_MEAN)) for n in (3, 11)
    )
    assert few == many and len(few) == 50
    none = spark.createDataFrame([(1, None)], "k int, v double")
    assert by_key(aggregate.fan_out(none, ["k"], ["v"], aggregate.EXACT_SUM_MEAN)) == {1: (0.0, None)}


def test_distinct_count_includes_missing(spark):
    df = spark.createDataFrame([(1,), (1,), (2,), (None,)], "x int")
    assert aggregate.distinct_count(df, "x").first()[0] == 3


def test_overall_mean_needs_no_join(groups):
    out = aggregate.with_overall_mean(groups, "v")
    assert {r.prop for r in out.collect()} == {3.0}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Window" not in plan


def test_selectors_ignore_case_and_refuse_unknown_names(groups):
    assert selectors.starts_with(groups, "V") == ["v"]
    assert selectors.numeric(groups) == ["v"] and selectors.character(groups) == ["k"]
    with pytest.raises(ValueError, match="no such column"):
        selectors.one_of(groups, ["FLAG_DOCUMENT_2"])
    assert [r[0] for r in selectors.names_frame(groups).collect()] == ["k", "v"]
    groups.createOrReplaceTempView("some_df")
    assert selectors.tables_like(groups.sparkSession, "_df$") == ["some_df"]


def test_left_join_refuses_further_shared_names(groups):
    with pytest.raises(ValueError, match="also share"):
        joins.left_join(groups, groups.withColumnRenamed("k", "K2").withColumn("k", F.col("K2")), ["k"])


def test_set_difference_is_distinct_and_null_safe(groups):
    left = groups.select("v")
    out = joins.set_difference(left, left.filter("v = 1"))
    assert sorted(r.v or 0 for r in out.collect()) == [0, 3.0, 5.0]


def test_bind_rows_fills_missing_columns(groups):
    out = joins.bind_rows(groups, groups.select("v"))
    assert out.filter("k IS NULL").count() == len(GROUPS)
