"""Mixing sources to target weights: hash-random order, distributed prefix sums, exact budgets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.llm.common import hash_key, key_range
from tallyframe.session import cut_lineage

WORD = "[^\\x20\\x09-\\x0D]+"
SEED = "mix"
ROWS_PER_RANGE = 10_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def ranked(sources: DataFrame, by: str, ranges: int = 64) -> DataFrame:
    """Position of each distinct source by code point from 0, missing last, as ``rank``.

    Sources are grouped by their first character: counts of the groups before give the offsets.
    """
    lead = sources.withColumn("__lead", F.substring(by, 1, 1))
    counts = lead.groupBy("__lead").agg(F.count(F.lit(1)).alias("__n"))
    order = [F.col("__lead").asc_nulls_last()]
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        F.col("__lead").alias("__to"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before")
    )
    inside = Window.partitionBy("__lead").orderBy(F.col(by).asc_nulls_last())
    return (
        lead.join(offsets, F.col("__lead").eqNullSafe(F.col("__to")))
        .withColumn("rank", F.col("__before") + F.row_number().over(inside) - 1)
        .drop("__lead", "__to", "__before")
    )


def water_fill(sources: DataFrame, share: float, most: float) -> DataFrame:
    """Adds ``target``: ``share`` of all sizes dealt by ``weight``, no target above ``most`` x its size.

    What a full source leaves over goes to the others by weight. Sources full at one level stay full
    at the next, so each round only raises the level; three sums come to the driver per round.
    """
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    cap = F.lit(float(most)) * F.col("source_size")
    full, rest = F.lit(False), None
    known = -1
    while True:
        n, taken, weight = sources.agg(
            F.count(F.when(full, 1)),
            F.coalesce(F.sum(F.when(full, cap)), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0)),
        ).first()
        left = share * total - taken
        if not weight or n == known:
            break
        known = n
        rest = F.col("weight") * F.lit(left) / F.lit(float(weight))
        full = rest >= cap
    return sources.withColumn("target", cap if rest is None else F.when(full, cap).otherwise(rest))


def plan_sources(
    rows: DataFrame, weights: Sequence[int], share: float, most: float, source: str = "source", size: str = "size"
) -> DataFrame:
    """One row per source: source_size, weight and target. ``weights`` repeat in source order."""
    sums = rows.groupBy(source).agg(F.sum(size).alias("source_size"))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    return water_fill(cut_lineage(ranked(sums, source).withColumn("weight", weight)), share, most)


def mix(
    docs: DataFrame,
    weights: Sequence[int] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    seed: str = SEED,
) -> DataFrame:
    """How many words of each document a mix of the sources takes.

    Columns: key, size (words), source, source_size, target, taken. Documents of a source stand in the
    order of a seeded hash of the key; whole epochs are taken while the target allows, and the last
    one is cut where the running sum of words meets the target, inside a document if need be. So
    a source's taken words fall short of its target by less than one word.

    Missing texts and texts without words have size 0 and nothing taken; a missing source is a source of
    its own, last in order; a missing key counts as an empty one. Repeated rows count as often as
    they occur and are interchangeable. A source of size 0 has target 0. No rows in, no rows out.
    Other input columns are ignored.
    """
    rows = cut_lineage(
        docs.select(
            F.col(f"`{key}`").alias("__id"),
            F.col(f"`{source}`").alias("source"),
            n_words(F.col(f"`{text}`")).alias("size"),
            hash_key(F.lit(seed), F.col(f"`{key}`")).alias("__key"),
        )
    )
    targets = cut_lineage(plan_sources(rows, weights, share, most).drop("rank", "weight"))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    targets = targets.select(
        F.col("source").alias("__of"),
        "source_size",
        "target",
        epochs.cast("bigint").alias("__epochs"),
        F.floor(F.col("target") - epochs * F.col("source_size")).cast("bigint").alias("__rest"),
    )
    ranges = max(16, rows.count() // ROWS_PER_RANGE)
    placed = rows.withColumn("__range", key_range(F.col("__key"), ranges))
    sums = placed.groupBy("source", "__range").agg(F.sum("size").alias("__sum"))
    earlier = Window.partitionBy("source").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        F.col("source").alias("__of"),
        F.col("__range").alias("__at"),
        F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__before"),
    )
    offsets = offsets.join(targets.withColumnRenamed("__of", "__t"), F.col("__of").eqNullSafe(F.col("__t"))).drop("__t")
    inside = (
        Window.partitionBy("source", "__range")
        .orderBy("__key", "__id", "size")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    start = F.col("__before") + F.sum("size").over(inside) - F.col("size")
    last = F.greatest(F.lit(0), F.least(F.col("size"), F.col("__rest") - start))
    return placed.join(
        offsets, F.col("source").eqNullSafe(F.col("__of")) & (F.col("__range") == F.col("__at"))
    ).select(
        F.col("__id").alias(key),
        "size",
        *([] if key == "source" else ["source"]),
        "source_size",
        "target",
        (F.col("__epochs") * F.col("size") + last).cast("bigint").alias("taken"),
    )


def mixed_documents(
    docs: DataFrame,
    weights: Sequence[int] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    seed: str = SEED,
) -> DataFrame:
    """The rows of ``docs`` as often as ``mix`` takes them, whole: a document that the cut divides is taken if at least
    half of it lies before. All columns stay, whatever their names; documents without words go. A missing source is one
    of its own; repeated rows are taken alike; no rows in, none out.

    Each source's cut is a place in hash order, so rows are decided by their source's row in a small table
    and no text is shuffled for it. Rows that are equal in key and size fall on one side of a cut.
    """
    taken = mix(docs, weights, share, most, key, text, source, seed).withColumnsRenamed({key: "__id"})
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.col("taken") - epochs * F.col("size")
    at = F.struct(hash_key(F.lit(seed), F.col("__id")).alias("k"), F.col("__id").alias("id"), F.col("size").alias("size"))
    cuts = taken.groupBy("source").agg(
        F.first(epochs).alias("__epochs"), F.max(F.when((rest > 0) & (2 * rest >= F.col("size")), at)).alias("__cut")
    )
    cuts = cut_lineage(cuts.withColumnRenamed("source", "__of"))
    size = n_words(F.col(f"`{text}`"))
    own = F.struct(
        hash_key(F.lit(seed), F.col(f"`{key}`")).alias("k"), F.col(f"`{key}`").alias("id"), size.alias("size")
    )
    rows = docs.select(F.struct("*").alias("__doc"), F.col(f"`{source}`").alias("__source"), own.alias("__own"))
    copies = F.col("__epochs") + F.when(F.col("__own") <= F.col("__cut"), 1).otherwise(0)
    rows = rows.join(cuts, F.col("__source").eqNullSafe(F.col("__of"))).withColumn("__copies", copies.cast("int"))
    rows = rows.filter((F.col("__own.size") > 0) & (F.col("__copies") > 0))
    return rows.select("__doc", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select("__doc.*")
