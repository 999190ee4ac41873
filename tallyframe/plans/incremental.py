"""Rollups kept up to date load by load: a new load rewrites the rows of its own keys and reads no older history."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.operators import selectors

PARTS = ("n", "total", "lowest", "highest")


def partials(df: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Per key: n_rows, and per measure how many values there are, their sum, minimum and maximum."""
    aggs: list[Column] = [F.count(F.lit(1)).alias("n_rows")]
    for m in selectors.one_of(df, measures):
        x = F.col(f"`{m}`")
        own = (F.count(x), F.sum(x.cast("double")), F.min(x), F.max(x))
        aggs += [a.alias(f"{m}_{p}") for a, p in zip(own, PARTS)]
    return df.groupBy(*keys).agg(*aggs)


def merge(rows: DataFrame, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """One row per key out of several rows of :func:`partials`."""
    fold = {"n": F.sum, "total": F.sum, "lowest": F.min, "highest": F.max}
    aggs = [F.sum("n_rows").alias("n_rows")]
    aggs += [fold[p](f"{m}_{p}").alias(f"{m}_{p}") for m in measures for p in PARTS]
    return rows.groupBy(*keys).agg(*aggs)


class RollupStore:
    """Versions of a rollup below a folder, one per load: the rows of the keys that the load touched, merged with what was
    known of them before. The newest row of a key is the one that counts.

    A load is added once; adding it again, say after a failure, changes nothing. One writer at a time.
    """

    def __init__(self, spark: SparkSession, folder: str, keys: Sequence[str], measures: Sequence[str]):
        self.spark, self.folder = spark, folder
        self.keys, self.measures = list(keys), list(measures)

    def _versions(self) -> list[tuple[int, str]]:
        """(version, load) of all complete versions, in order: one folder per load."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        root = jvm.org.apache.hadoop.fs.Path(self.folder)
        store = root.getFileSystem(conf)
        if not store.exists(root):
            return []
        found = []
        for entry in store.listStatus(root):
            path = entry.getPath()
            if store.exists(jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")):
                version, _, load = path.getName().removeprefix("version=").partition("-")
                found.append((int(version), load))
        return sorted(found)

    def _read(self, upto: int | None = None) -> DataFrame | None:
        parts = [
            self.spark.read.parquet(f"{self.folder}/version={v:06d}-{load}").withColumn("__version", F.lit(v))
            for v, load in self._versions()
            if upto is None or v <= upto
        ]
        if not parts:
            return None
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p)
        return rows

    def _newest(self, rows: DataFrame) -> DataFrame:
        columns = [c for c in rows.columns if c not in (*self.keys, "__version")]
        newest = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*columns), "__version").alias("__row"))
        return newest.select(*self.keys, "__row.*")

    def add(self, load: str, df: DataFrame) -> None:
        """Merge one load. Older rows are read for its keys only, and only those keys are written."""
        if not load.replace("_", "").isalnum():
            raise ValueError(f"a load's name has letters, digits and _ only: {load!r}")
        known = self._versions()
        if load in [name for _, name in known]:
            return
        fresh = partials(df, self.keys, self.measures)
        older = self._read()
        if older is not None:
            # A missing key is a key like any other.
            own = fresh.select(*[F.col(k).alias(f"__{k}") for k in self.keys])
            same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in self.keys])
            touched = older.join(own, same, "left_semi")
            fresh = merge(self._newest(touched).unionByName(fresh), self.keys, self.measures)
        version = known[-1][0] + 1 if known else 0
        fresh.write.mode("overwrite").parquet(f"{self.folder}/version={version:06d}-{load}")

    def rows_written(self, load: str) -> int:
        version = next(v for v, name in self._versions() if name == load)
        return self.spark.read.parquet(f"{self.folder}/version={version:06d}-{load}").count()

    def rollup(self, functions: Iterable[str] = ("max", "min", "mean", "sum")) -> DataFrame:
        """Per key n_rows and ``<measure>_<function>``: what one aggregate over all loads would give. Maximum, minimum and mean
        of nothing are NULL, its sum is 0."""
        rows = self._read()
        if rows is None:
            raise ValueError("no load was added yet")
        now = self._newest(rows)
        of = {
            "max": lambda m: F.col(f"{m}_highest"),
            "min": lambda m: F.col(f"{m}_lowest"),
            "mean": lambda m: F.try_divide(F.col(f"{m}_total"), F.col(f"{m}_n")),
            "sum": lambda m: F.coalesce(F.col(f"{m}_total"), F.lit(0.0)),
        }
        return now.select(*self.keys, "n_rows", *[of[f](m).alias(f"{m}_{f}") for m in self.measures for f in functions])
