"""Marking rows by a bitmap of fixed size, so that rows without a mark need not move."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARK_BITS = 26  # 8 MB
U64 = np.uint64


def _slots(ids: np.ndarray) -> np.ndarray:
    x = ids.astype(np.int64).view(U64) * U64(0x9E3779B97F4A7C15)
    return (x >> U64(64 - MARK_BITS)).astype(np.int64)


def marked(marks: np.ndarray, ids: np.ndarray) -> np.ndarray:
    at = _slots(ids)
    return (marks[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def marks_of(ids: DataFrame) -> np.ndarray:
    """A bitmap of 2 ** MARK_BITS bits with the slots of all ids set. Whatever their number, its size is fixed: with
    very many, it lets more documents through than needed, and a join drops the others."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.zeros(1 << (MARK_BITS - 3), np.uint8)
        for batch in batches:
            if batch.schema.names == ["id"]:
                at = _slots(batch.column("id").to_numpy(False))
                np.bitwise_or.at(marks, at >> 3, (1 << (at & 7)).astype(np.uint8))
            else:
                for b in batch.column("marks").to_pylist():
                    marks |= np.frombuffer(zlib.decompress(b), np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(marks.tobytes(), 1)], pa.binary())], names=["marks"])

    merged = ids.mapInArrow(merge, "marks binary").repartition(16).mapInArrow(merge, "marks binary")
    merged = merged.repartition(1).mapInArrow(merge, "marks binary").first()
    return np.frombuffer(zlib.decompress(merged[0]), np.uint8) if merged else np.zeros(1 << (MARK_BITS - 3), np.uint8)


def split_by_marks(docs: DataFrame, id_of: Column, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows whose id is marked, and the others; each as its whole row ``__doc`` and its id ``__id``.

    ``ids`` has a column id of 64-bit numbers. All rows with one of these ids are marked, and a few others.
    """
    marks = docs.sparkSession.sparkContext.broadcast(marks_of(ids))  # a bitmap of fixed size

    @F.arrow_udf("boolean")
    def is_marked(own: pa.Array) -> pa.Array:
        return pa.array(marked(marks.value, own.to_numpy(zero_copy_only=False)), pa.bool_())

    rows = docs.select(F.struct("*").alias("__doc"), id_of.alias("__id")).withColumn("__marked", is_marked("__id"))
    return rows.filter("__marked").drop("__marked"), rows.filter("NOT __marked").drop("__marked")
