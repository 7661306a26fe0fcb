"""Centroid clustering over whole numbers with an incrementally updated distance matrix.

Every vector keeps its exact dot products with all centroids as a row of a
table.  When centroids move, the products change by the changed components
alone: component times change, added up; then each vector takes its nearest
centroid anew.  A round is one pass without a shuffle, and one sum of every
component over each cluster; the driver holds the centroids only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, read, release
from .vectors import block, lists, vectors

CENTROIDS, ROUNDS, COMPONENTS, SCALE, SEED = 40, 5, 64, 256, 2
#: Components below it in size have products and squared distances that fit 64 bits.
LARGEST = 1 << 27

STATE = "vec_id long, x array<long>, dots array<long>, cluster int, distance long"


def _whole(scale: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.floor(scale * block(batch.column(1), width))
            if x.size and np.abs(x).max() >= LARGEST:
                raise ValueError(f"a component times {scale} is {LARGEST} or more: squared distances would not fit in a long")
            yield pa.RecordBatch.from_arrays([batch.column(0), lists(x.astype(np.int64), pa.int64())], ["vec_id", "x"])

    return run


def _state(ids: pa.Array, x: np.ndarray, dots: np.ndarray, centroids: np.ndarray) -> pa.RecordBatch:
    """Rows of STATE: the nearest centroid of each vector, of equally near ones the first."""
    score = (centroids * centroids).sum(axis=1) - 2 * dots
    cluster = score.argmin(axis=1).astype(np.int32)
    distance = (x * x).sum(axis=1) + score[np.arange(len(x)), cluster]
    return pa.RecordBatch.from_arrays([ids, lists(x, pa.int64()), lists(dots, pa.int64()), pa.array(cluster), pa.array(distance)], ["vec_id", "x", "dots", "cluster", "distance"])


def _begun(centroids: np.ndarray):
    """All dot products, once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = block(batch.column(1), centroids.shape[1])
            yield _state(batch.column(0), x, x @ centroids.T, centroids)

    return run


def updated(x: np.ndarray, dots: np.ndarray, change: np.ndarray) -> np.ndarray:
    """``dots`` after centroids moved by ``change``, from its components that are not zero."""
    dots = dots.copy()
    for at in np.flatnonzero(change.any(axis=0)):
        moved = np.flatnonzero(change[:, at])
        dots[:, moved] += x[:, at, None] * change[moved, at]
    return dots


def _moved(centroids: np.ndarray, change: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, dots = block(batch.column(1), centroids.shape[1]), block(batch.column(2), len(centroids))
            yield _state(batch.column(0), x, updated(x, dots, change), centroids)

    return run


def _means(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Componentwise floor of each cluster's mean; empty clusters' centroids as they are."""
    sums = state.groupBy("cluster").agg(F.count("*").alias("n"), *[F.sum(F.get("x", F.lit(i))).alias(f"s{i}") for i in range(centroids.shape[1])])
    out = centroids.copy()
    for row in sums.collect():  # a row a centroid
        out[row["cluster"]] = [row[f"s{i}"] // row["n"] for i in range(centroids.shape[1])]
    return out


def cluster(
    table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = CENTROIDS, rounds: int = ROUNDS,
    components: int = COMPONENTS, scale: int = SCALE, seed: int = SEED,
) -> DataFrame:
    """(vec_id, x, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector of ``components`` finite numbers.

    x: the floors of ``scale`` times the components.  Centroids start as the
    ``k`` vectors with the least SHA-256 of ``seed:vec_id`` (fewer vectors:
    fewer centroids; equal ids: in order of x; no id: of ``seed:none``).
    Each round takes every vector to its nearest centroid, ties to the smaller
    number, and every centroid with vectors to the floor of their mean; then
    vectors are assigned once more.  Rows that repeat an id are vectors of
    their own.  Null vectors, other lengths, null and non-finite components
    are left out; no vectors: no rows.  A component of ``LARGEST`` or more in
    size is an error.
    """
    spark = table.sparkSession
    rows = vectors(table, id_col, vector_col).filter(F.size("v") == components)
    rows = cut(rows.mapInArrow(_whole(scale, components), "vec_id long, x array<long>"), "centroid-vectors")
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("none"))), 256)
    first = rows.select(order.alias("key"), "x").orderBy("key", "x").limit(k).collect()
    shape = "vec_id long, x array<long>, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not first:
        return spark.createDataFrame([], shape)
    centroids = np.array([r.x for r in first], np.int64)
    state = cut(rows.mapInArrow(_begun(centroids), STATE), "centroid-state")
    release(rows)
    for _ in range(rounds):
        means = _means(state, centroids)
        change = means - centroids
        if not change.any():  # nothing moves any more, in later rounds either
            break
        before, centroids = state, means
        state = cut(before.mapInArrow(_moved(centroids, change), STATE), "centroid-state")
        release(before)
    inertia = {r["cluster"]: int(r["sum"]) for r in state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(19,0)")).alias("sum")).collect()}
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    about = spark.createDataFrame([(n, inertia.get(n, 0), sum(inertia.values()), name) for n, name in enumerate(names)], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    found = state.select("vec_id", "x", "cluster", "distance").join(F.broadcast(about), "cluster")  # a row a centroid
    return found.select("vec_id", "x", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(read(spark, sf_dir, "embeddings")).drop("x")
