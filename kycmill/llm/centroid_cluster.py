"""Centroid clustering (Lloyd's rounds) in whole numbers, with a distance matrix that is kept and updated.

Every vector keeps its exact dot product with each centroid. After a round a centroid has moved by a vector of
whole numbers in which many components are zero; the kept products change by the vector's components at the
non-zero places times that move, and by nothing else. The squared distance follows from the product and the two
squared lengths, and the nearest centroid from the distances. The products are written out with the vectors
after every round, so an executor that is lost costs the tasks it ran and no earlier round.

What passes the driver has a size of its own: ``k`` centroids, and ``k`` rows of component sums.

Defined cases: vectors that are null, have another number of components, or hold a null or non-finite component
take no part; components beyond ``LIMIT`` count as that limit, so that every distance fits a long; rows with the
same id are separate vectors; a null id is a start only where others are lacking; with fewer vectors than ``k``
there are as many centroids as vectors; a sum of distances beyond a long is null; an empty table gives an empty
table; other columns do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Largest component after scaling: 64 squares of twice this fit a long.
LIMIT = 1 << 27
STATE = "vec_id long, v array<int>, dots array<long>, cluster int, distance long"


def usable(vector: Column, size: int | None = None) -> Column:
    """True for vectors of this size (or of any size but 0) without null or non-finite components."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) == size if size else F.size(vector) > 0) & ~odd, F.lit(False))


def whole_vectors(vectors: DataFrame, key: str, vector: str, size: int, scale: int) -> DataFrame:
    """``vec_id`` and ``v``: the components times ``scale``, rounded down."""
    whole = F.transform(
        F.col(vector),
        lambda x: F.greatest(F.least(F.floor(x.cast("double") * scale), F.lit(LIMIT)), F.lit(-LIMIT)).cast("int"),
    )
    return vectors.filter(usable(F.col(vector), size)).select(F.col(key).cast("long").alias("vec_id"), whole.alias("v"))


def starts(vectors: DataFrame, k: int, size: int, seed: int) -> np.ndarray:
    """The ``k`` vectors whose ids hash lowest."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = vectors.orderBy(order.asc_nulls_last(), "v").limit(k).collect()
    return np.array([r.v for r in first], np.int64).reshape(len(first), size)


def _columns(batch: pa.RecordBatch, name: str, width: int) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width).astype(np.int64)


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    ends = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.ravel(), kind))


def _moved(state: DataFrame, before: np.ndarray, after: np.ndarray) -> DataFrame:
    """The state with products and nearest centroids after the centroids have moved (first: from nowhere)."""
    move, norms = after - before, (after * after).sum(1)
    places = [np.flatnonzero(m) for m in move]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            v = _columns(batch, "v", after.shape[1])
            dots = _columns(batch, "dots", len(after))
            for c, at in enumerate(places):
                if len(at):
                    dots[:, c] += v[:, at] @ move[c, at]
            far = norms[None, :] - 2 * dots + (v * v).sum(1)[:, None]
            near = far.argmin(1)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id"),
                    _lists(v, pa.int32()),
                    _lists(dots, pa.int64()),
                    pa.array(near, pa.int32()),
                    pa.array(far[np.arange(len(far)), near], pa.int64()),
                ],
                ["vec_id", "v", "dots", "cluster", "distance"],
            )

    return state.mapInArrow(run, STATE)


def _means(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Each centroid's vectors' mean, rounded down by component; a centroid without vectors stays."""
    sums = [F.sum(F.col("v")[i].cast("long")).alias(f"s{i}") for i in range(centroids.shape[1])]
    out = centroids.copy()
    for row in state.groupBy("cluster").agg(F.count("*").alias("n"), *sums).collect():
        out[row.cluster] = [row[f"s{i}"] // row.n for i in range(centroids.shape[1])]
    return out


def cluster_vectors(
    vectors: DataFrame,
    k: int = 16,
    rounds: int = 3,
    size: int = 64,
    scale: int = 64,
    seed: int = 1,
    key: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """``vec_id``, ``cluster``, ``distance``, ``cluster_inertia``, ``inertia``, ``centroid`` per usable vector."""
    spark = vectors.sparkSession
    whole = whole_vectors(vectors, key, vector, size, scale)
    centroids = starts(whole, k, size, seed)
    if len(centroids) == 0:
        empty = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid array<int>"
        return spark.createDataFrame([], empty)
    nothing = F.array_repeat(F.lit(0).cast("long"), len(centroids))
    state = _moved(whole.withColumn("dots", nothing), np.zeros_like(centroids), centroids)
    for _ in range(rounds):
        state = stored(state, "centroid-products")
        moved = _means(state, centroids)
        state, centroids = _moved(state, centroids, moved), moved
    state = stored(state, "centroid-products").select("vec_id", "cluster", "distance")
    parts = state.groupBy("cluster").agg(F.try_sum("distance").alias("cluster_inertia")).collect()
    sums = [r.cluster_inertia for r in parts]
    total = None if None in sums or sum(sums) >= 1 << 63 else sum(sums)
    found = spark.createDataFrame(
        [(r.cluster, r.cluster_inertia, total, centroids[r.cluster].tolist()) for r in parts],
        "cluster int, cluster_inertia long, inertia long, centroid array<int>",
    )
    return state.join(F.broadcast(found), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid"
    )


def centroid_digest(centroid: Column) -> Column:
    return F.sha2(F.array_join(centroid, ",").cast("binary"), 256)


def plain_digest(centroid: list[int]) -> str:
    """The same outside Spark."""
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()
