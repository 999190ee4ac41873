"""Score quality against brute force, and training invariants."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.operators import sampling
from tallyframe.plans import model, train


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 1500)
    s = np.clip(np.round(rng.normal(0.4 + 0.2 * y, 0.2), 2), 0, 1)
    return spark.createDataFrame(list(zip(y.tolist(), s.tolist())), "y int, s double").cache()


def arrays(scored):
    rows = scored.collect()
    y, s = np.array([r.y for r in rows]), np.array([r.s for r in rows])
    return s[y == 1], s[y == 0]


@pytest.mark.parametrize("buckets", [2, 64])
def test_auc(scored, buckets):
    pos, neg = arrays(scored)
    brute = (pos[:, None] > neg).mean() + (pos[:, None] == neg).mean() / 2
    assert model.auc(scored, "y", "s", buckets).first().auc == pytest.approx(brute, rel=1e-12)


def test_auc_agrees_with_the_evaluator(scored):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    evaluator = BinaryClassificationEvaluator(rawPredictionCol="s", labelCol="y")
    got = evaluator.evaluate(scored.withColumn("y", F.col("y").cast("double")))
    assert model.auc(scored, "y", "s").first().auc == pytest.approx(got, abs=1e-9)


def test_auc_of_one_class_is_missing(scored):
    assert model.auc(scored.filter("y = 1"), "y", "s").first().auc is None


def test_roc_thresholds(scored):
    pos, neg = arrays(scored)
    for r in model.roc_thresholds(scored, "y", "s").collect():
        assert r.sensitivity == (pos >= r.threshold).mean()
        assert r.specificity == (neg < r.threshold).mean()


def test_threshold_intervals_match_a_row_bootstrap(scored):
    pos, neg = arrays(scored)
    rng = np.random.default_rng(5)
    se = [(rng.choice(pos, len(pos)) >= 0.5).mean() for _ in range(2000)]
    sp = [(rng.choice(neg, len(neg)) < 0.5).mean() for _ in range(2000)]
    out = model.roc_threshold_ci(scored, "y", "s").collect()
    r = next(r for r in out if r.threshold == 0.5)
    assert [r.se_low, r.se_median, r.se_high] == pytest.approx(
        np.quantile(se, [0.025, 0.5, 0.975]).tolist(), abs=0.006
    )
    assert [r.sp_low, r.sp_median, r.sp_high] == pytest.approx(
        np.quantile(sp, [0.025, 0.5, 0.975]).tolist(), abs=0.006
    )
    again = model.roc_threshold_ci(scored.repartition(3), "y", "s").collect()
    assert sorted(map(tuple, out)) == sorted(map(tuple, again))


def test_training_finds_a_separable_target(spark):
    df = spark.range(600).select(
        "id",
        F.when(F.col("id") % 6 > 0, (F.col("id") % 10 > 4).cast("int")).alias("y"),
        (F.col("id") % 10).alias("signal"),
        F.when(F.col("id") % 4 > 0, F.col("id") % 7).alias("noise"),
    )
    rows = sampling.three_way_split(df, "id", "y")
    names = model.feature_names(rows, "id", "y")
    assert names == ["signal", "noise"]
    frame = model.model_frame(rows, "id", "y", names, keep=["split"]).cache()
    known = frame.filter("split <> 'test'").withColumn("v", F.col("split") == "validation")
    fitted = model.fit_boosted(known, model.SHALLOW.with_rounds(3), "v")
    out = model.score(fitted, frame)
    assert out.filter("score < 0 OR score > 1").count() == 0
    held = out.filter("split = 'validation'").withColumn("label", F.col("label").cast("int"))
    assert model.auc(held, "label", "score").first().auc > 0.99
    again = model.score(model.fit_boosted(known, model.SHALLOW.with_rounds(3), "v"), frame)
    assert out.orderBy("id").collect() == again.orderBy("id").collect()
    ranked = model.importance(fitted, frame, names).orderBy("rank").collect()
    assert [r.feature for r in ranked][0] == "signal"
    sent = model.submission(out.filter("split = 'test'"), "id")
    assert dict(sent.dtypes) == {"id": "bigint", "TARGET": "double"} and sent.count() == 100


def test_rows_without_a_score_count_nowhere(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.1), (0, None), (None, 0.5), (1, None)], "y int, s double")
    kept = df.dropna()
    assert model.auc(df, "y", "s").collect() == model.auc(kept, "y", "s").collect()
    assert model.roc_thresholds(df, "y", "s").collect() == model.roc_thresholds(kept, "y", "s").collect()
    rows = lambda d: sorted(map(tuple, model.score_intervals(d, "y", "s").collect()))
    assert rows(df) == rows(kept)
    assert tuple(model.auc(df.filter("s IS NULL"), "y", "s").first()) == (None, 0, 0)


def test_model_frame_fills_nan_and_submission_keeps_large_ids(spark):
    df = spark.createDataFrame([(2**40, 1, float("nan")), (2, 0, None)], "id bigint, y int, v double")
    frame = model.model_frame(df, "id", "y", ["v"])
    assert [r.features.toArray().tolist() for r in frame.collect()] == [[0.0], [0.0]]
    sent = model.submission(frame.withColumn("score", F.lit(0.5)), "id")
    assert {r.id for r in sent.collect()} == {2**40, 2}


def test_the_whole_path_on_a_separable_target(spark, tmp_path):
    df = spark.range(900).select(
        "id",
        F.when(F.col("id") % 6 > 0, (F.col("id") % 10 > 7).cast("int")).alias("y"),
        (F.col("id") % 10).alias("SIGNAL_A"),
        (F.col("id") % 7).alias("NOISE"),
    )
    done = train.train(df, "id", "y", model.SHALLOW.with_rounds(5))
    assert done.metric > 0.99 and done.features == ["SIGNAL_A", "NOISE"]
    ranked = [tuple(r) for r in done.importance().orderBy("rank").collect()]
    assert [r[2] for r in ranked] == [1, 2] and sum(r[1] for r in ranked) == pytest.approx(1)
    assert [(r.feature, r["rank"]) for r in done.importance("^NOISE").collect()] == [("NOISE", 2)]
    path = done.write(str(tmp_path), "id")
    assert path.endswith(f"scores_{round(done.metric, 4)}.csv")
    back = spark.read.csv(path, header=True, inferSchema=True)
    assert back.count() == 150 and back.filter("TARGET < 0 OR TARGET > 1").count() == 0
