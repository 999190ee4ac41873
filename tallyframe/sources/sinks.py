"""Writing scores, profiles and feature tables. Every task writes its own files."""

from __future__ import annotations

from pyspark.sql import DataFrame


def score_path(folder: str, best_metric: float, stem: str = "scores") -> str:
    return f"{folder}/{stem}_{round(best_metric, 4)}.csv"


def write_scores(df: DataFrame, folder: str, best_metric: float, stem: str = "scores") -> str:
    """Scored rows as headed CSV, in a folder whose name carries the rounded best metric."""
    path = score_path(folder, best_metric, stem)
    df.write.mode("overwrite").csv(path, header=True)
    return path


def write_profiles(profiles: DataFrame, folder: str, variable: str = "variable") -> None:
    """One sub-folder per variable, out of one job over the long profile table.

    Profile rows are spread over tasks by the writer's adaptive rebalancing, so a variable with many
    rows is split over several files.
    """
    profiles.hint("rebalance", variable).write.mode("overwrite").partitionBy(variable).parquet(folder)


def write_features(df: DataFrame, path: str) -> DataFrame:
    """Write a wide table once and go on from the files, so later passes do not recompute it."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)
