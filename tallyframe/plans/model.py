"""Boosted-tree training, importance, scoring and score quality."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions import aggregates as A
from tallyframe.operators import ordered, sampling, selectors

# Fixed values.
THRESHOLDS = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)
REPLICATES = 2000
CONFIDENCE = 0.95


@dataclass(frozen=True)
class Preset:
    """Training settings. ``tolerance`` ends training when validation loss stops falling."""

    step: float
    depth: int
    subsample: float
    column_share: float
    min_rows: int
    seed: int
    rounds: int = 30
    tolerance: float = 0.001

    def with_rounds(self, rounds: int) -> Preset:
        return replace(self, rounds=rounds)


# Fixed values. Rounds are fewer than the thousands a native booster would run: each round is a
# series of cluster jobs. 15 leaves correspond to depth 4.
DEEP = Preset(step=0.025, depth=6, subsample=0.8, column_share=0.632, min_rows=19, seed=42)
SHALLOW = Preset(step=0.1, depth=4, subsample=0.9, column_share=0.9, min_rows=20, seed=314)


def feature_names(df: DataFrame, id_col: str, target: str, exclude: Iterable[str] = ()) -> list[str]:
    """Numeric columns other than id and target; text columns are no features unless encoded first."""
    return selectors.numeric(df, [id_col, target, *exclude])


def model_frame(
    df: DataFrame, id_col: str, target: str | None, features: Sequence[str], keep: Sequence[str] = ()
) -> DataFrame:
    """Id, label and one feature vector per row; a missing number or NaN counts as 0."""
    chosen = selectors.one_of(df, features)
    label = [F.col(target).cast("double").alias("label")] if target else []
    plain = df.select(
        id_col,
        *label,
        *keep,
        *[F.nanvl(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(c) for c in chosen],
    )
    out = VectorAssembler(inputCols=chosen, outputCol="features").transform(plain)
    return out.select(id_col, *(["label"] if target else []), *keep, "features")


def fit_boosted(
    frame: DataFrame, preset: Preset, validation_flag: str | None = None
) -> GBTClassificationModel:
    """Fit on a :func:`model_frame`; rows with ``validation_flag`` only decide when to stop."""
    learner = GBTClassifier(
        labelCol="label",
        featuresCol="features",
        maxIter=preset.rounds,
        stepSize=preset.step,
        maxDepth=preset.depth,
        subsamplingRate=preset.subsample,
        featureSubsetStrategy=str(preset.column_share),
        minInstancesPerNode=preset.min_rows,
        seed=preset.seed,
    )
    if validation_flag:
        learner = learner.setValidationIndicatorCol(validation_flag)
        learner = learner.setParams(validationTol=preset.tolerance)
    return learner.fit(frame)


def importance(
    model: GBTClassificationModel, df: DataFrame, features: Sequence[str], pattern: str = ""
) -> DataFrame:
    """Features by falling importance, ranked from 1. One row per feature, so the ranking is tiny.

    ``pattern`` keeps the names that match it somewhere, with their rank among all features."""
    ranked = sorted(
        zip(features, model.featureImportances.toArray().tolist()), key=lambda p: (-p[1], p[0])
    )
    rows = [(name, float(gain), i) for i, (name, gain) in enumerate(ranked, 1) if re.search(pattern, name)]
    return df.sparkSession.createDataFrame(rows, "feature string, importance double, rank int")


def score(model: GBTClassificationModel, frame: DataFrame, name: str = "score") -> DataFrame:
    """Probability of class 1 beside each row."""
    scored = model.transform(frame)
    return scored.withColumn(name, vector_to_array("probability")[1]).drop(
        "features", "rawPrediction", "probability", "prediction"
    )


def submission(
    scored: DataFrame, id_col: str, score_col: str = "score", id_type: str = "bigint"
) -> DataFrame:
    return scored.select(
        F.col(id_col).cast(id_type).alias(id_col), F.col(score_col).alias("TARGET")
    )


def auc(scored: DataFrame, label: str, score_col: str, buckets: int | None = None) -> DataFrame:
    """Exact area under the ROC curve: share of (positive, negative) pairs in order, ties half.

    Equal scores are merged first, so the sort is over distinct scores; it is range-bucketed, and
    each positive only needs the number of negatives below it.
    """
    runs = (
        scored.filter(F.col(label).isNotNull() & F.col(score_col).isNotNull())
        .groupBy(F.col(score_col).alias("s"))
        .agg(
            A.count_where(F.col(label) == 1).alias("pos"),
            A.count_where(F.col(label) == 0).alias("neg"),
        )
    )
    placed = ordered.running_sums(runs, "s", ["neg"], buckets)
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    return placed.agg(
        F.try_divide(
            F.sum(pos * (F.col("neg_before").cast("double") + neg / 2)), F.sum(pos) * F.sum(neg)
        ).alias("auc"),
        F.coalesce(F.sum("pos"), F.lit(0)).alias("n_pos"),
        F.coalesce(F.sum("neg"), F.lit(0)).alias("n_neg"),
    )


def _rows_from(cells: list[Column]) -> Column:
    return F.inline(F.array(*cells))


def roc_thresholds(
    scored: DataFrame, label: str, score_col: str, thresholds: Sequence[float] = THRESHOLDS
) -> DataFrame:
    """Sensitivity and specificity per threshold, from one scan; a score at the threshold counts as positive.

    Rows without a label or a score count nowhere, here and in all score statistics."""
    known = F.col(label).isNotNull() & F.col(score_col).isNotNull()
    y, s = F.col(label), F.col(score_col)
    aggs = [A.count_where(y == 1).alias("n_pos"), A.count_where(y == 0).alias("n_neg")]
    for i, t in enumerate(thresholds):
        aggs.append(A.count_where((y == 1) & (s >= F.lit(float(t)))).alias(f"tp{i}"))
        aggs.append(A.count_where((y == 0) & (s < F.lit(float(t)))).alias(f"tn{i}"))
    counts = scored.filter(known).agg(*aggs)
    return counts.select(
        _rows_from(
            [
                F.struct(
                    F.lit(float(t)).alias("threshold"),
                    F.try_divide(F.col(f"tp{i}").cast("double"), F.col("n_pos")).alias("sensitivity"),
                    F.try_divide(F.col(f"tn{i}").cast("double"), F.col("n_neg")).alias("specificity"),
                )
                for i, t in enumerate(thresholds)
            ]
        )
    )


def score_intervals(
    scored: DataFrame, label: str, score_col: str, thresholds: Sequence[float] = THRESHOLDS
) -> DataFrame:
    """Rows per (class, interval between thresholds): all that threshold statistics depend on."""
    above = sum(
        (F.when(F.col(score_col) >= F.lit(float(t)), 1).otherwise(0) for t in thresholds), F.lit(0)
    )
    return (
        scored.filter(F.col(label).isNotNull() & F.col(score_col).isNotNull())
        .groupBy(F.col(label).cast("int").alias("label"), above.alias("interval"))
        .agg(A.row_count().alias("n"))
    )


def roc_threshold_ci(
    scored: DataFrame,
    label: str,
    score_col: str,
    thresholds: Sequence[float] = THRESHOLDS,
    replicates: int = REPLICATES,
    confidence: float = CONFIDENCE,
    seed: int = 42,
) -> DataFrame:
    """Bootstrap intervals of sensitivity and specificity, classes resampled separately.

    Drawing n rows with replacement and counting them per interval is one multinomial draw over the
    intervals, so replicates are drawn from the class x interval counts. The scores are scanned
    once, however many replicates there are.
    """
    thresholds = [float(t) for t in thresholds]
    k = len(thresholds) + 1
    counts = {0: np.zeros(k, dtype=np.int64), 1: np.zeros(k, dtype=np.int64)}
    # At most two classes times k intervals.
    for r in score_intervals(scored, label, score_col, thresholds).collect():
        counts[r["label"]][r["interval"]] = r["n"]
    sizes = {c: int(v.sum()) for c, v in counts.items()}
    if not sizes[0] or not sizes[1]:
        raise ValueError("threshold intervals need rows of both classes")

    def draw(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for batch in batches:
            for replicate in batch["id"]:
                rng = np.random.default_rng([seed, int(replicate)])
                share = {}
                for c in (0, 1):
                    hits = rng.multinomial(sizes[c], counts[c] / sizes[c])
                    share[c] = np.cumsum(hits[::-1])[::-1][1:] / sizes[c]
                yield pd.DataFrame(
                    {
                        "threshold": thresholds,
                        "sensitivity": share[1],
                        "specificity": 1.0 - share[0],
                    }
                )

    drawn = scored.sparkSession.range(replicates).mapInPandas(
        draw, "threshold double, sensitivity double, specificity double"
    )
    tail = (1 - confidence) / 2
    probs = [tail, 0.5, 1 - tail]
    # Each group holds one value per replicate.
    both = drawn.groupBy("threshold").agg(
        F.percentile("sensitivity", probs).alias("se"), F.percentile("specificity", probs).alias("sp")
    )
    return both.select(
        "threshold",
        *[
            F.col(m)[i].alias(f"{m}_{name}")
            for m in ("se", "sp")
            for i, name in enumerate(("low", "median", "high"))
        ],
    )


def poisson_intervals(
    scored: DataFrame,
    id_col: str,
    label: str,
    score_col: str,
    thresholds: Sequence[float] = THRESHOLDS,
    replicates: int = 100,
    seed: int = 42,
) -> DataFrame:
    """(replicate, label, interval, n): class x score-interval counts of bootstrap replicates in which every row draws its
    own Poisson count of mean 1 from a hash of id and replicate. One pass, whatever the number of rows; the counts are
    summed on the map side, so the result is replicates x classes x intervals rows."""
    above = sum((F.when(F.col(score_col) >= F.lit(float(t)), 1).otherwise(0) for t in thresholds), F.lit(0))
    known = scored.filter(F.col(label).isNotNull() & F.col(score_col).isNotNull())
    rows = known.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("label"), above.alias("interval"))
    each = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"))
    n = sampling.poisson_count(F.concat_ws("-", "id", "replicate"), 1.0, seed)
    return each.groupBy("replicate", "label", "interval").agg(F.sum(n).alias("n"))


def poisson_threshold_ci(
    scored: DataFrame,
    id_col: str,
    label: str,
    score_col: str,
    thresholds: Sequence[float] = THRESHOLDS,
    replicates: int = 200,
    confidence: float = CONFIDENCE,
    seed: int = 42,
) -> DataFrame:
    """As :func:`roc_threshold_ci`, from :func:`poisson_intervals`: replicate sizes vary too."""
    counts = poisson_intervals(scored, id_col, label, score_col, thresholds, replicates, seed)
    n = lambda c, *at: F.coalesce(F.sum(F.when((F.col("label") == c) & (F.lit(True) if not at else at[0]), F.col("n"))), F.lit(0))
    sides = []
    for i, t in enumerate(thresholds):
        above = F.col("interval") > i
        sides.append(
            F.struct(
                F.lit(float(t)).alias("threshold"),
                F.try_divide(n(1, above).cast("double"), n(1)).alias("sensitivity"),
                F.try_divide(n(0, ~above).cast("double"), n(0)).alias("specificity"),
            )
        )
    per_replicate = counts.groupBy("replicate").agg(F.array(*sides).alias("sides")).select(F.inline("sides"))
    tail = (1 - confidence) / 2
    probs = [tail, 0.5, 1 - tail]
    # Each group holds one value per replicate.
    both = per_replicate.groupBy("threshold").agg(
        F.percentile("sensitivity", probs).alias("se"), F.percentile("specificity", probs).alias("sp")
    )
    names = ("low", "median", "high")
    return both.select("threshold", *[F.col(m)[i].alias(f"{m}_{x}") for m in ("se", "sp") for i, x in enumerate(names)])
