"""Row numbers, running sums and quantiles against brute force, with hot values and hot groups."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.operators import ordered


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share one value, and a third belong to one group."""
    rng = np.random.default_rng(7)
    n = 6000
    value = np.where(rng.random(n) < 0.34, 5.0, np.round(rng.lognormal(1, 2, n), 3))
    group = np.where(rng.random(n) < 0.34, 0, rng.integers(1, 40, n))
    data = [(int(i), int(g), float(v)) for i, (g, v) in enumerate(zip(group, value))]
    return spark.createDataFrame(data, "id long, g int, v double").repartition(7).cache()


@pytest.mark.parametrize("buckets", [2, 32, 500])
def test_row_number(skewed, buckets):
    out = ordered.with_row_number(skewed, ["v", "id"], buckets=buckets).collect()
    got = {r.id: r.row_number for r in out}
    brute = sorted((r.v, r.id) for r in out)
    assert got == {i: k for k, (_, i) in enumerate(brute, 1)}


def test_row_number_splits_a_hot_value(skewed):
    found = ordered.sketch(skewed, ["v"], 32)
    assert list(found.hot("v")) == [5.0] and 9 <= found.hot("v")[5.0] <= 13


def test_row_number_of_a_column_with_few_values(skewed):
    few = skewed.withColumn("v", (F.col("id") % 3).cast("int"))
    out = ordered.with_row_number(few, ["v", "id"], buckets=64).collect()
    brute = sorted((r.v, r.id) for r in out)
    assert {r.id: r.row_number for r in out} == {i: k for k, (_, i) in enumerate(brute, 1)}


def test_row_number_puts_missing_values_last(skewed):
    gaps = skewed.withColumn("v", F.when(F.col("id") % 3 > 0, F.col("v")))
    out = ordered.with_row_number(gaps, ["v", "id"], buckets=32).collect()
    brute = sorted((r.v is None, r.v or 0.0, r.id) for r in out)
    assert {r.id: r.row_number for r in out} == {b[2]: k for k, b in enumerate(brute, 1)}


def test_running_sums(skewed):
    runs = skewed.groupBy("v").agg(F.sum("g").alias("g"), F.count(F.lit(1)).alias("n"))
    out = ordered.running_sums(runs, "v", ["g", "n"], buckets=16).orderBy("v").collect()
    g = n = 0
    for r in out:
        assert (r.g_before, r.n_before) == (g, n)
        g, n = g + r.g, n + r.n
    assert n == 6000


@pytest.mark.parametrize("limit", [ordered.BROADCAST_ROWS, 0])
def test_grouped_quantiles(skewed, monkeypatch, limit):
    monkeypatch.setattr(ordered, "BROADCAST_ROWS", limit)
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 1.0]
    out = ordered.exact_quantiles(skewed, ["g"], "v", probs, buckets=50).collect()
    rows = skewed.collect()
    assert len(out) == len({r.g for r in rows})
    for r in out:
        values = [x.v for x in rows if x.g == r.g]
        assert (r.n, r.lowest, r.highest) == (len(values), min(values), max(values))
        got = [r[f"q{i}"] for i in range(len(probs))]
        assert got == pytest.approx(np.quantile(values, probs).tolist(), rel=1e-12)


def test_quantiles_small_and_missing(spark):
    df = spark.createDataFrame(
        [(None, 1.0), (None, 2.0), ("a", 3.0), ("a", None), ("b", None)], "k string, v double"
    )
    got = {r.k: (r.n, r.q0) for r in ordered.exact_quantiles(df, ["k"], "v", [0.5]).collect()}
    assert got == {None: (2, 1.5), "a": (1, 3.0)}


def test_overall_quantiles(skewed):
    r = ordered.exact_quantiles(skewed, [], "v", [0.25, 0.75]).first()
    brute = np.quantile([x.v for x in skewed.collect()], [0.25, 0.75])
    assert [r.q0, r.q1] == pytest.approx(brute.tolist(), rel=1e-12)


def test_results_do_not_depend_on_partitioning(skewed):
    a = ordered.exact_quantiles(skewed, ["g"], "v", [0.3]).orderBy("g").collect()
    b = ordered.exact_quantiles(skewed.repartition(3), ["g"], "v", [0.3]).orderBy("g").collect()
    assert a == b


def test_top_k_keeps_the_best_per_task(skewed):
    out = ordered.top_k(skewed, [F.desc("v"), "id"], 5)
    assert "TakeOrderedAndProject" in out._jdf.queryExecution().executedPlan().toString()
    assert out.count() == 5


KINDS = {
    "double": "CAST(IF(id % 3 = 0, 7, id * 1.5) AS DOUBLE)",
    "decimal": "CAST(IF(id % 3 = 0, 7.25, id * 1.5) AS DECIMAL(12,2))",
    "date": "IF(id % 3 = 0, DATE'2020-01-01', date_add(DATE'2000-01-01', CAST(id AS INT)))",
    "timestamp": "IF(id % 3 = 0, TIMESTAMP'2020-01-01 00:00:00', timestamp_seconds(id * 100))",
    "odd": "CASE WHEN id % 3 = 0 THEN NULL WHEN id % 5 = 0 THEN DOUBLE('NaN') WHEN id % 7 = 0 THEN"
    " DOUBLE('Infinity') WHEN id % 11 = 0 THEN DOUBLE('-Infinity') ELSE id END",
    "one value": "CAST(1 AS DOUBLE)",
    "all missing": "CAST(NULL AS DOUBLE)",
}


@pytest.mark.parametrize("kind", KINDS)
def test_row_numbers_of_every_kind(spark, kind):
    df = spark.range(3000).selectExpr(f"{KINDS[kind]} AS v", "(id * 7919) % 3001 AS tie", "id")
    got = ordered.with_row_number(df, ["v", "tie"], buckets=40).orderBy("row_number").select("id", "row_number").collect()
    want = df.orderBy(F.col("v").asc_nulls_last(), "tie").select("id").collect()
    assert [r.id for r in got] == [r.id for r in want]
    assert [r.row_number for r in got] == list(range(1, 3001))


def test_row_numbers_of_ties_without_a_second_column(spark):
    df = spark.range(2000).selectExpr("CAST(IF(id % 2 = 0, 5, id) AS DOUBLE) AS v")
    got = ordered.with_row_number(df, ["v"], buckets=40)
    assert got.columns == ["v", "row_number"]
    rows = [tuple(r) for r in got.orderBy("row_number").collect()]
    assert [r[1] for r in rows] == list(range(1, 2001)) and [r[0] for r in rows] == sorted(r[0] for r in rows)


def test_empty_and_missing_input(spark):
    none = spark.createDataFrame([], "k int, v double, id bigint")
    missing = spark.createDataFrame([(1, None, 1), (1, None, 2)], "k int, v double, id bigint")
    for df in (none, missing):
        assert ordered.with_row_number(df, ["v", "id"]).count() == df.count()
        assert tuple(ordered.exact_quantiles(df, [], "v", [0.5]).first()) == (0, None, None, None)
        assert ordered.exact_quantiles(df, ["k"], "v", [0.5]).count() == 0


def test_buckets_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(ordered, "BUCKET_ROWS", 10)
    assert ordered.bucket_target(spark.range(1000)) == 100
    assert ordered.bucket_target(spark.range(0)) == ordered.MIN_BUCKETS


# ---- more rows than the sketch has buckets for


@pytest.fixture
def coarse(monkeypatch):
    monkeypatch.setattr(ordered, "MIN_BUCKETS", 2)
    monkeypatch.setattr(ordered, "MAX_BUCKETS", 3)
    monkeypatch.setattr(ordered, "BUCKET_ROWS", 10)


def test_refined_buckets_keep_the_order(spark, coarse):
    df = spark.range(3000).select("id", ((F.col("id") * 7919) % 1009).cast("double").alias("x"))
    found = ordered.sketch(df, ["x"])
    assert found.is_coarse and len(found.quantiles["x"]) == 2
    fine = ordered.refine_buckets(ordered.range_bucket(df, "x", found.cuts("x")), "x")
    sizes = fine.groupBy("bucket").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("x").alias("n")).orderBy("bucket").collect()
    assert len(sizes) > 300 and max(r.n for r in sizes) <= 40
    assert all(a.hi < b.lo for a, b in zip(sizes, sizes[1:]))


def test_ordered_work_on_refined_buckets(spark, coarse):
    table = [(i, float(i * 7919 % 101) if i % 11 else None if i % 2 else float("nan")) for i in range(900)]
    table += [(i, 50.0) for i in range(900, 1300)]
    df = spark.createDataFrame(table, "id bigint, x double")
    rank = lambda v: (2, 0) if v is None else (1, 0) if v != v else (0, v)
    want = [i for i, _ in sorted(table, key=lambda r: (rank(r[1]), r[0]))]
    got = ordered.with_row_number(df, ["x", "id"]).orderBy("row_number").collect()
    assert [r.id for r in got] == want and [r.row_number for r in got] == list(range(1, len(table) + 1))
    runs = df.filter("x IS NOT NULL AND NOT isnan(x)").groupBy("x").agg(F.count(F.lit(1)).alias("n"))
    sums = {r.x: r.n_before for r in ordered.running_sums(runs, "x", ["n"]).collect()}
    values = [v for _, v in table if v is not None and v == v]
    assert sums == {v: sum(w < v for w in values) for v in set(values)}
    clean = df.filter("x IS NOT NULL AND NOT isnan(x)")
    q = ordered.exact_quantiles(clean, [], "x", [0.0, 0.25, 0.5, 0.9, 1.0]).first()
    assert [q[f"q{i}"] for i in range(5)] == pytest.approx(np.quantile(values, [0, 0.25, 0.5, 0.9, 1]).tolist())
