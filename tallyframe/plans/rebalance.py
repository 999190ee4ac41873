"""Split the derived table and rebalance its training part."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.operators import sampling
from tallyframe.session import cut_lineage


@dataclass(frozen=True)
class Splits:
    """``rows`` holds all parts, with columns ``split`` and ``copy``; the parts have the input's columns."""

    rows: DataFrame
    train: DataFrame
    validation: DataFrame
    test: DataFrame


def split_plan(
    keys: DataFrame,
    id_col: str,
    target: str,
    fraction: float = sampling.TRAIN_FRACTION,
    share: float = sampling.MINORITY_SHARE,
    seed: int = sampling.SEED,
) -> DataFrame:
    """Per id its split and how often it occurs there: class-1 training rows 0, 1 or more times, others once."""
    labelled = sampling.three_way_split(keys.select(id_col, target), id_col, target, fraction, seed)
    train = labelled.filter(F.col("split") == "train")
    drawn = sampling.bootstrap_copies(train, id_col, target, share, seed)
    redrawn = (F.col("split") == "train") & (F.col(target) == 1)
    return labelled.join(drawn, id_col, "left").select(
        id_col,
        target,
        "split",
        F.when(redrawn, F.coalesce("copies", F.lit(0))).otherwise(1).cast("bigint").alias("copies"),
    )


def apply_plan(wide: DataFrame, plan: DataFrame, id_col: str) -> DataFrame:
    """The wide rows with their split, repeated as the plan says. The wide table is read once."""
    drawn = plan.filter(F.col("copies") > 0).select(id_col, "split", "copies")
    return (
        wide.join(drawn, id_col)
        .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))))
        .select(*wide.columns, "split", "copy")
    )


def split_rebalance(
    wide: DataFrame,
    id_col: str,
    target: str,
    keys: DataFrame | None = None,
    fraction: float = sampling.TRAIN_FRACTION,
    share: float = sampling.MINORITY_SHARE,
    seed: int = sampling.SEED,
) -> Splits:
    """Rebalanced training rows, untouched validation rows and unlabelled test rows.

    The wide table is computed and written once, below the checkpoint folder; the parts are filters
    of the files. Pass ``keys`` (id and class) from the subject table, or the wide table is
    written before the split is planned.
    """
    if keys is None:
        wide = keys = cut_lineage(wide)
    plan = split_plan(keys, id_col, target, fraction, share, seed)
    rows = cut_lineage(apply_plan(wide, plan, id_col))
    return Splits(
        rows,
        *[
            rows.filter(F.col("split") == s).select(*wide.columns)
            for s in ("train", "validation", "test")
        ]
    )
