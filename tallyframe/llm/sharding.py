"""Sharding by weighted rendezvous hashing of stable record keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.llm.common import hash_key, key_range, only
from tallyframe.session import cut_lineage

SEED = "shard"
ROWS_PER_RANGE = 10_000


def rendezvous(key: Column, weights: Sequence[float], seed: str = SEED) -> Column:
    """Number of the shard that scores highest for ``key``.

    Each shard scores weight / -ln(u), with u drawn from the hash of (seed, key, shard), so a shard
    wins keys in proportion to its weight. One more shard only adds a score: a key either stays or
    moves into the new shard. Equal scores go to the smaller number; a shard of weight 0 gets none.
    """
    if not weights or min(weights) < 0 or max(weights) <= 0:
        raise ValueError("weights must be non-negative, one of them positive")
    scores = []
    for shard, weight in enumerate(weights):
        digits = F.substring(hash_key(F.lit(seed), key, F.lit(shard)), 1, 13)
        unit = (F.conv(digits, 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(float(1 << 52))
        if weight:
            scores.append(F.struct((F.lit(float(weight)) / -F.ln(unit)).alias("score"), F.lit(-shard).alias("n")))
    return -F.array_max(F.array(*scores))["n"]


def number_within(df: DataFrame, group: Sequence[str], key: str, ties: Sequence[str], out: str) -> DataFrame:
    """Gapless numbers from 0 within each group, in the order of (key, ties).

    ``key`` is a hash, so cutting its space evenly cuts each group evenly: rows are numbered in
    pieces of about ROWS_PER_RANGE, and counts of the pieces before give each piece its offset.
    ``df`` is read three times; pass a written table.
    """
    ranges = max(16, df.count() // ROWS_PER_RANGE)
    placed = df.withColumn("__range", key_range(F.col(key), ranges))
    counts = placed.groupBy(*group, "__range").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    inside = Window.partitionBy(*group, "__range").orderBy(key, *ties)
    return (
        placed.join(offsets, [*group, "__range"])
        .withColumn(out, F.col("__before") + F.row_number().over(inside) - 1)
        .drop("__range", "__before")
    )


def assign_shards(
    docs: DataFrame,
    weights: Sequence[float],
    key: str = "doc_id",
    text: str = "text",
    grown_weight: float = 1.0,
    seed: str = SEED,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Per record its shard, its place in the shard, and its shard were there one more.

    Columns: key, the ``keep`` ones, size (UTF-8 bytes of the text, plus 1), text_crc32, law ('key'),
    shard, slot (gapless from 0 in each shard), grown_shard. Only the key decides the shard, so
    copies of a text spread over the shards and a repeated key stays together. A missing text has
    size 1 and the CRC of no bytes; a missing key counts as an empty one. Rows that agree in key, CRC
    and size are interchangeable. Other input columns are ignored, so their names cannot clash;
    ``keep`` may not name a result column. No rows in, no rows out.
    """
    made = {"size", "text_crc32", "law", "shard", "slot", "grown_shard"}
    if made & {key, *keep}:
        raise ValueError(f"result columns clash: {sorted(made & {key, *keep})}")
    raw = F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")
    k = F.col(f"`{key}`")
    rows = docs.select(
        k,
        *[F.col(f"`{c}`") for c in keep],
        (F.octet_length(raw) + 1).cast("bigint").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.lit("key").alias("law"),
        rendezvous(k, weights, seed).cast("int").alias("shard"),
        rendezvous(k, [*weights, grown_weight], seed).cast("int").alias("grown_shard"),
        hash_key(F.lit("slot"), k, F.crc32(raw)).alias("__order"),
    )
    rows = cut_lineage(rows)
    numbered = number_within(rows, ["shard"], "__order", [key, "size"], "slot")
    return only(numbered, key, *keep, "size", "text_crc32", "law", "shard", "slot", "grown_shard")
