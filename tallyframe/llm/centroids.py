"""K-means over whole-number vectors by Orchard's search: exact, with ties to the smaller centroid number."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.session import cut_lineage

WIDTH = 64
SCALE = 64
CENTROIDS = 16
ROUNDS = 3


def whole_vectors(rows: DataFrame, key: str, vector: str, width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """(__id, __v): floor(scale * x) of each component, for vectors of ``width`` finite components.

    A component so large that four times a squared distance might not fit 64 bits fails the job.
    """
    limit = isqrt((1 << 59) // width)
    finite = F.forall("__x", lambda c: F.coalesce(F.abs(c.cast("double")) < F.lit(float("inf")), F.lit(False)))

    def whole(c):
        scaled = c.cast("double") * F.lit(float(scale))
        too_large = F.raise_error(F.lit(f"a component times {scale} is beyond {limit}")).cast("int")
        return F.when(F.abs(scaled) < F.lit(float(min(limit, (1 << 31) - 1))), F.floor(scaled).cast("int")).otherwise(too_large)

    return (
        rows.select(F.col(f"`{key}`").alias("__id"), F.col(f"`{vector}`").alias("__x"))
        .filter((F.size("__x") == width) & finite)
        .select("__id", F.transform("__x", whole).alias("__v"))
    )


def orchard(x: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid of each row, its squared distance, and the number of distances computed.

    Every centroid has a list of all centroids, nearest first. A row walks the list of the closest centroid found so
    far, passing over those it has visited; a closer one, or an equally close one of smaller number, sends it to
    that one's list. It stops at a list entry strictly beyond twice its current distance: from there on the
    triangle inequality leaves no centroid as close. All rows take their steps together.
    """
    n, k = len(x), len(centers)
    between = np.stack([((centers - c) ** 2).sum(1) for c in centers])
    lists = np.argsort(between, axis=1, kind="stable")
    gaps = np.take_along_axis(between, lists, 1)
    best = np.zeros(n, np.int64)
    distance = ((x - centers[0]) ** 2).sum(1)
    visited = np.zeros((n, k), bool)
    visited[:, 0] = True
    place = np.zeros(n, np.int64)
    live, compared = np.arange(n), n
    while len(live):
        at, own = place[live], best[live]
        in_reach = gaps[own, at] <= 4 * distance[live]
        live, at, own = live[in_reach], at[in_reach], own[in_reach]
        other = lists[own, at]
        fresh = ~visited[live, other]
        rows, candidate = live[fresh], other[fresh]
        compared += len(rows)
        visited[rows, candidate] = True
        d = ((x[rows] - centers[candidate]) ** 2).sum(1)
        closer = (d < distance[rows]) | ((d == distance[rows]) & (candidate < best[rows]))
        place[live] = at + 1
        jump = rows[closer]
        best[jump], distance[jump], place[jump] = candidate[closer], d[closer], 0
        live = live[place[live] < k]
    return best, distance, compared


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def first_centers(vectors: DataFrame, k: int = CENTROIDS, seed: int = 1) -> np.ndarray:
    """The ``k`` vectors with the smallest sha256 of ``<seed>:<key>``, equal keys by their components."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("__id").cast("string"), F.lit("")))
    top = vectors.select(F.sha2(name, 256).alias("h"), "__v").orderBy("h", "__v").limit(k)
    return np.array([r["__v"] for r in top.collect()], np.int64)


def moved(vectors: DataFrame, centers: np.ndarray) -> np.ndarray:
    """Each centroid replaced by the floored mean of the vectors nearest to it, if there are any."""
    k, width = centers.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, sizes = np.zeros((k, width), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            x = _matrix(batch.column("__v"), width)
            if len(x):
                nearest = orchard(x, centers)[0]
                sums += (nearest == np.arange(k)[:, None]).astype(np.int64) @ x
                sizes += np.bincount(nearest, minlength=k)
        some = np.flatnonzero(sizes)
        yield pa.RecordBatch.from_arrays(
            [pa.array(some, pa.int32()), pa.array(sizes[some]), pa.array(sums[some].tolist(), pa.list_(pa.int64()))],
            names=["cluster", "n", "sums"],
        )

    parts = vectors.select("__v").mapInArrow(run, "cluster int, n bigint, sums array<bigint>")
    total = lambda i: F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}")
    out = centers.copy()
    for r in parts.groupBy("cluster").agg(F.sum("n").alias("n"), *[total(i) for i in range(width)]).collect():
        out[r["cluster"]] = [int(r[f"s{i}"]) // r["n"] for i in range(width)]
    return out


def assigned(vectors: DataFrame, centers: np.ndarray) -> DataFrame:
    """(__id, cluster, distance) of every vector."""
    kind = vectors.schema["__id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                nearest, distance, _ = orchard(_matrix(batch.column("__v"), centers.shape[1]), centers)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("__id"), pa.array(nearest, pa.int32()), pa.array(distance)],
                    names=["__id", "cluster", "distance"],
                )

    return vectors.mapInArrow(run, f"__id {kind}, cluster int, distance bigint")


def cluster_vectors(
    rows: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    k: int = CENTROIDS,
    rounds: int = ROUNDS,
    width: int = WIDTH,
    scale: int = SCALE,
    seed: int = 1,
) -> DataFrame:
    """Per vector its cluster and squared distance, beside its cluster's: key, cluster, distance, cluster_inertia,
    inertia, centroid_sha256.

    Vectors of another length, or with a missing or non-finite component, and missing vectors are left out.
    Components become floor(scale * x). Centroids start as the vectors with the ``k`` smallest hashes of seed and key; each
    round assigns all vectors and replaces each centroid that has some by their floored mean. Ties go to
    the smaller number. Repeated rows count each and may be two centroids; a missing key hashes as an empty
    one; with fewer than ``k`` vectors there are fewer centroids, with none no rows. Other columns are ignored.

    Only ``k`` centroids and ``k`` rows of sums per round pass the driver; tasks combine their own rows first, so a cluster of
    any size is one row per task.
    """
    vectors = cut_lineage(whole_vectors(rows, key, vector, width, scale))
    centers = first_centers(vectors, k, seed).reshape(-1, width)
    for _ in range(rounds if len(centers) else 0):
        centers = moved(vectors, centers)
    found = cut_lineage(assigned(vectors, centers))
    inertia = F.sum(F.col("distance").cast("decimal(38,0)"))
    sums = {r[0]: int(r[1]) for r in found.groupBy("cluster").agg(inertia).collect()}
    digest = lambda c: hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()
    known = [(c, s, sum(sums.values()), digest(centers[c])) for c, s in sorted(sums.items())]
    schema = "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    about = found.sparkSession.createDataFrame(known, schema)  # k rows at most
    return found.join(F.broadcast(about), "cluster").select(
        F.col("__id").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
