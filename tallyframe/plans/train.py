"""One path from the feature table to written scores: split, rebalance, fit, judge, rank, score, write."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.operators import coding, selectors
from tallyframe.plans import boosting, model, rebalance
from tallyframe.session import cut_lineage
from tallyframe.sources import sinks


def feature_columns(df: DataFrame, id_col: str, target: str, exclude: Iterable[str] = ()) -> list[str]:
    """Numeric and text columns other than id and target, in the table's order."""
    usable = {*selectors.numeric(df, [id_col, target, *exclude]), *selectors.character(df)} - {id_col, target, *exclude}
    return [c for c in df.columns if c in usable]


@dataclass(frozen=True)
class Trained:
    """``rows``: vectors or binned features with label, split and copy. ``metric``: AUC on the validation rows (None
    without both classes). ``scores``: id and score of every row of the validation and test parts."""

    model: GBTClassificationModel | boosting.Booster
    features: list[str]
    rows: DataFrame
    metric: float | None
    scores: DataFrame

    def importance(self, pattern: str = "") -> DataFrame:
        if isinstance(self.model, boosting.Booster):
            return self.model.importance(self.rows.sparkSession, pattern)
        return model.importance(self.model, self.rows, self.features, pattern)

    def submission(self, id_col: str) -> DataFrame:
        return model.submission(self.scores.filter(F.col("split") == "test"), id_col)

    def write(self, folder: str, id_col: str, stem: str = "scores") -> str:
        """Scores of the test rows as CSV, in a folder named after the validation metric."""
        return sinks.write_scores(self.submission(id_col), folder, self.metric or 0.0, stem)


def train(
    wide: DataFrame,
    id_col: str,
    target: str,
    preset: boosting.Settings | model.Preset,
    keys: DataFrame | None = None,
    exclude: Iterable[str] = (),
) -> Trained:
    """Fit on the rebalanced training rows of ``wide``; validation rows end the training and judge it.

    The wide table is written once, and its features once, so no round of the training computes a rollup. Features
    are all columns but id, target and ``exclude``: numbers, and texts by the codes of the training rows, the same
    for all parts. With a :class:`model.Preset` MLlib's trees are fitted, on the numbers only.
    """
    parts = rebalance.split_rebalance(wide, id_col, target, keys)
    if isinstance(preset, boosting.Settings):
        return _boosted(wide, parts, id_col, target, preset, exclude)
    names = model.feature_names(wide, id_col, target, exclude)
    rows = cut_lineage(model.model_frame(parts.rows, id_col, target, names, keep=["split", "copy"]))
    known = rows.filter(F.col("split") != "test")
    fitted = model.fit_boosted(
        known.withColumn("is_validation", F.col("split") == "validation"), preset, "is_validation"
    )
    scores = model.score(fitted, rows.filter(F.col("split") != "train")).select(
        id_col, F.col("label").cast("int").alias("label"), "split", "score"
    )
    scores = cut_lineage(scores)
    held = scores.filter(F.col("split") == "validation")
    return Trained(fitted, names, rows, model.auc(held, "label", "score").first()["auc"], scores)


def _boosted(wide, parts, id_col, target, settings, exclude) -> Trained:
    names = feature_columns(wide, id_col, target, exclude)
    texts = [c for c in selectors.character(wide) if c in names]
    is_train = F.col("split") == "train"
    table = coding.apply_codes(parts.rows, coding.code_table(parts.rows.filter(is_train), texts), texts)
    cuts = boosting.find_cuts(table.filter(is_train), names, settings.bins)
    rows = cut_lineage(boosting.bin_rows(table, id_col, target, names, cuts, keep=["split", "copy"]))
    known = rows.filter(F.col("split") != "test").withColumn("is_validation", F.col("split") == "validation")
    fitted = boosting.fit(known, names, cuts, settings, "is_validation")
    scores = fitted.score(rows.filter(~is_train)).select(id_col, F.col("label").cast("int").alias("label"), "split", "score")
    scores = cut_lineage(scores)
    held = scores.filter(F.col("split") == "validation")
    return Trained(fitted, names, rows, model.auc(held, "label", "score").first()["auc"], scores)
