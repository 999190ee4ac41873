"""Ledgers, incremental rollups, Poisson draws, observed profiles and stored partitioning against the exact operators."""

import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.operators import joins, ledgers, ordered, profile, sampling
from tallyframe.plans import incremental, model
from tallyframe.session import cut_lineage, ensure_checkpoint_dir


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# ---- ledgers


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.range(40_000).select(
        (F.col("id") % 3).alias("g"),
        (F.col("id") % 17).alias("h"),
        F.when(F.col("id") % 5 > 0, (F.hash("id") % 100_000).cast("double")).alias("x"),
        F.col("id").alias("k"),
    )
    return cut_lineage(df)


def test_quantiles_from_a_merged_ledger(rows):
    fine = cut_lineage(ledgers.sketch_ledger(rows, ["g", "h"], ["x"], ["k"]))
    probs = [0.1, 0.5, 0.9]
    got = {r.g: r for r in ledgers.ledger_quantiles(fine.filter("variable = 'x'"), ["g"], probs).collect()}
    exact = {r.g: r for r in ordered.exact_quantiles(rows, ["g"], "x", probs).collect()}
    data = rows.toPandas()
    for g, r in got.items():
        own = data[data.g == g].x
        assert (r.n, r.n_missing, r.lowest, r.highest) == (own.count(), own.isna().sum(), exact[g].lowest, exact[g].highest)
        assert abs(r.n_distinct - own.nunique()) < 0.03 * own.nunique()
        values = np.sort(own.dropna().to_numpy())
        for p, v in zip(probs, (r.q0, r.q1, r.q2)):
            assert abs(np.searchsorted(values, v) / len(values) - p) < 0.015
    one = ledgers.merge_ledger(fine, []).filter("variable = 'k'").first()
    assert one.n == 40_000 and one.lowest is None


def test_ledgers_without_values(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, float("nan")), (2, 3.0)], "g int, x double")
    got = {r.g: r for r in ledgers.ledger_quantiles(ledgers.sketch_ledger(df, ["g"], ["x"]), ["g"], [0.5]).collect()}
    assert (got[1].n, got[1].n_missing, got[1].q0, got[1].n_distinct) == (0, 2, None, 0)
    assert (got[2].n, got[2].q0, got[2].highest) == (2, 3.0, 3.0)
    assert ledgers.ledger_quantiles(ledgers.sketch_ledger(df.filter("g = 9"), ["g"], ["x"]), ["g"], [0.5]).count() == 0


def test_coverage_of_keys_of_different_types(spark):
    left = ledgers.sketch_ledger(spark.range(1000).select((F.col("id") % 2).alias("g"), "id"), ["g"], keys=["id"])
    right = ledgers.sketch_ledger(spark.range(0, 2000, 4).select(F.lit(0).alias("z"), F.col("id").cast("int").alias("key")), ["z"], keys=["key"])
    got = {r.g: tuple(r)[1:] for r in ledgers.ledger_coverage(left, "id", right, "key", ["g"]).collect()}
    assert got == {0: (500, 250, 250, 0.5), 1: (500, 0, 500, 0.0)}
    nothing = ledgers.ledger_coverage(left, "id", right.filter("z = 1"), "key").first()
    assert tuple(nothing) == (1000, 0, 1000, 0.0)


# ---- incremental rollups


def test_loads_add_up_and_touch_their_keys_only(spark, tmp_path):
    rng = np.random.default_rng(3)
    table = [(int(k), None if v < 3 else float(v), "ab"[i % 2]) for i, (k, v) in enumerate(zip(rng.integers(0, 40, 600), rng.integers(0, 50, 600)))]
    table += [(None, 5.0, "a"), (99, None, "b")]
    df = spark.createDataFrame(table, "key bigint, v double, load string")
    store = incremental.RollupStore(spark, str(tmp_path), ["key"], ["v"])
    with pytest.raises(ValueError):
        store.rollup()
    store.add("a", df.filter("load = 'a'"))
    store.add("b", df.filter("load = 'b'"))
    late = spark.createDataFrame([(99, 7.0), (500, 1.0), (None, 1.0)], "key bigint, v double")
    store.add("late", late)
    store.add("late", late)
    assert store.rows_written("late") == 3
    whole = df.select("key", "v").unionByName(late)
    want = whole.groupBy("key").agg(
        F.count(F.lit(1)).alias("n_rows"), F.max("v"), F.min("v"), F.avg("v"), F.coalesce(F.sum("v"), F.lit(0.0))
    )
    key = lambda r: (r[0] is None, r[0])
    kept = [tuple(r) for r in store.rollup().collect()]
    assert len({r[0] for r in kept}) == len(kept)
    by_key = {r[0]: r for r in kept if r[0] is not None}
    assert by_key == {r[0]: tuple(r) for r in want.collect() if r[0] is not None}
    assert sorted(kept, key=key)[-1] == (None, 2, 5.0, 1.0, 3.0, 6.0)
    with pytest.raises(ValueError):
        store.add("../x", late)


def test_an_unfinished_load_does_not_count(spark, tmp_path):
    store = incremental.RollupStore(spark, str(tmp_path), ["key"], ["v"])
    df = spark.createDataFrame([(1, 2.0)], "key bigint, v double")
    store.add("one", df)
    (tmp_path / "version=000001-two").mkdir()
    store.add("two", df)
    assert [tuple(r)[:4] for r in store.rollup().collect()] == [(1, 2, 2.0, 2.0)]


# ---- Poisson draws


def test_poisson_counts_have_their_distribution(spark):
    for rate in (0.3, 1.0, 6.5, 40.0):
        n = np.array([r[0] for r in spark.range(20_000).select(sampling.poisson_count("id", rate)).collect()])
        assert abs(n.mean() - rate) < 5 * (rate / 20_000) ** 0.5 and abs(n.var() / rate - 1) < 0.1
    assert sampling.poisson_limits(0.0) == [1.0]
    with pytest.raises(ValueError):
        sampling.poisson_limits(1e6)


def test_poisson_upsample_is_one_pass(spark):
    df = spark.range(30_000).select("id", F.when(F.col("id") % 10 == 0, 1).when(F.col("id") % 11 > 0, 0).alias("y"), F.lit(1).alias("__copies"))
    out = sampling.poisson_upsample(df, "id", "y")
    assert "Join" not in plan(out) and "Exchange" not in plan(out)
    sizes = {r.y: r.n for r in out.groupBy("y").agg(F.count("*").alias("n")).collect()}
    assert sizes[0] == df.filter("y = 0").count() and abs(sizes[1] / (sizes[0] + sizes[1]) - 0.3) < 0.01
    assert out.columns == df.columns
    with pytest.raises(ValueError):
        sampling.poisson_upsample(df.filter("y = 0"), "id", "y")


def test_poisson_intervals_scan_once(spark):
    scored = spark.range(400).select("id", (F.col("id") % 2).alias("y"), (F.col("id") % 100 / 100).alias("s"))
    got = model.poisson_intervals(scored, "id", "y", "s", replicates=30)
    assert "Join" not in plan(got)
    per = got.groupBy("replicate").agg(F.sum("n").alias("n")).collect()
    assert len(per) == 30 and abs(np.mean([r.n for r in per]) - 400) < 20


# ---- observed profiles


def test_observed_profile_equals_the_separate_ones(spark, tmp_path):
    df = spark.range(3000).select(
        "id", (F.col("id") % 2).alias("flag"), (F.col("id") % 99).alias("near_limit"), F.when(F.col("id") % 4 > 0, "a").alias("t")
    )
    seen = profile.write_observed(df, str(tmp_path / "t"), {"high": F.col("id") >= 2000})
    assert seen.n_rows == 3000 and seen.checks == {"high": 1000} and seen.table.count() == 3000
    assert seen.kinds == profile.column_kinds(df)
    assert seen.missing == {r.variable: r.na_prop for r in profile.missing_shares(df, df.columns).collect()}
    none = profile.write_observed(df.filter("id < 0"), str(tmp_path / "e"))
    assert none.n_rows == 0 and set(none.missing.values()) == {None}


# ---- stored partitioning


def test_bucketed_star_join_has_no_exchange(spark):
    def stored(df):
        name = f"t_{uuid.uuid4().hex}"
        return joins.store_bucketed(df, ["k"], name, f"{ensure_checkpoint_dir(spark)}/{name}", 4)

    base = spark.range(500).withColumnRenamed("id", "k")
    sides = [base.filter(f"k % {m} = 0").withColumn(f"v{m}", F.col("k") * m) for m in (2, 3)]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = joins.star_join(stored(base), [stored(s) for s in sides], ["k"])
        assert "Exchange" not in plan(got) and plan(got).count("SortMergeJoin") == 2
        assert "Exchange" in plan(joins.star_join(base, sides, ["k"]))
        assert sorted(map(tuple, got.collect())) == [(k, 2 * k if k % 2 == 0 else None, 3 * k if k % 3 == 0 else None) for k in range(500)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
