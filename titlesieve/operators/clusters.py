"""Cluster model: K-means fit, nearest-centroid assignment, sizes."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from ..config import ScreeningConfig
from ..functions.vectors import best_by_inner_product, matrix
from ..session import ship_package

_BLOCK = 4_096  # vectors of a stored block
_CELLS = 1 << 21  # distances held at once


def cluster_count(rows: int, cfg: ScreeningConfig) -> int:
    """Square root of half the rows, clamped to the configured bounds and to the rows there are."""
    guess = max(cfg.min_clusters, min(cfg.max_clusters, int(math.sqrt(rows / 2))))
    return max(1, min(guess, rows))


def load_model(centroids: DataFrame, cfg: ScreeningConfig) -> tuple[np.ndarray, np.ndarray]:
    """Cluster ids and centroids for the kernels. A cluster model is small by construction
    (``max_clusters``); a table above ``max_model_rows`` is refused rather than collected."""
    rows = (
        centroids.select("cluster_id", "centroid").orderBy("cluster_id").limit(cfg.max_model_rows + 1).collect()
    )
    if len(rows) > cfg.max_model_rows:
        raise ValueError(f"cluster model has more than {cfg.max_model_rows} centroids")
    ids = np.array([r["cluster_id"] for r in rows], dtype=np.int64)
    model = np.array([r["centroid"] for r in rows], dtype=np.float32)
    return ids, model


def _directions(model: np.ndarray) -> np.ndarray:
    wide = model.astype(np.float64)
    return wide / (np.linalg.norm(wide, axis=1, keepdims=True) + 1e-9)


def with_nearest_clusters(
    df: DataFrame, ids: np.ndarray, model: np.ndarray, top_n: int, out: str = "cluster_ids"
) -> DataFrame:
    """Add the ``top_n`` clusters nearest to ``embedding`` by cosine, best first, ties by lower id;
    an empty array without a model."""
    if not len(ids):
        return df.withColumn(out, F.array().cast("array<int>"))
    directions = _directions(model).astype(np.float32)
    schema = StructType([*df.schema.fields, StructField(out, ArrayType(IntegerType()))])

    def run(batches):
        for batch in batches:
            rows, got, _ = best_by_inner_product(matrix(batch.column("embedding")), directions, ids, top_n)
            offsets = np.searchsorted(rows, np.arange(batch.num_rows + 1)).astype(np.int32)
            near = pa.ListArray.from_arrays(pa.array(offsets), pa.array(got.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns, near], names=[*batch.schema.names, out])

    return df.mapInArrow(run, schema)


def _blocks(points: DataFrame) -> RDD:
    """The points as arrays of at most ``_BLOCK`` rows, kept for all iterations and dealt evenly over the cores."""
    spark = points.sparkSession
    ship_package(spark)
    parts = max(spark.sparkContext.defaultParallelism, points.rdd.getNumPartitions())

    def pack(rows):
        held = []
        for row in rows:
            held.append(row["features"].toArray())
            if len(held) == _BLOCK:
                yield np.array(held)
                held = []
        if held:
            yield np.array(held)

    dealt = points.repartition(parts, "id").rdd
    return dealt.mapPartitions(pack).persist(StorageLevel.MEMORY_AND_DISK)


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of models (models, k, d) the nearest centre of every row in each and its squared distance."""
    models, k, d = centres.shape
    far = x @ centres.reshape(-1, d).T
    far *= -2.0
    far += np.einsum("mkd,mkd->mk", centres, centres).ravel()
    far = far.reshape(len(x), models, k)
    near = far.argmin(axis=2)
    least = np.take_along_axis(far, near[:, :, None], axis=2)[:, :, 0] + np.einsum("ij,ij->i", x, x)[:, None]
    return near, np.maximum(least, 0.0)


def _fit_together(blocks: RDD, starts: list[np.ndarray], cfg: ScreeningConfig) -> np.ndarray:
    """Lloyd's iterations of all restarts in the same passes over the points, each restart until no centre moves
    by more than 1e-4; a centre without points stays. The centres of the restart with the least cost."""
    sc, centres = blocks.context, np.array(starts)
    k = centres.shape[1]
    costs, live = np.zeros(len(starts)), np.arange(len(starts))
    for _ in range(cfg.kmeans_iterations):
        shared = sc.broadcast(centres[live])

        def step(parts, shared=shared):
            models = shared.value
            m, k, d = models.shape
            sums, counts, cost = np.zeros((m, k, d)), np.zeros((m, k)), np.zeros(m)
            rows = max(_CELLS // (m * k), 1)
            for block in parts:
                for at in range(0, len(block), rows):
                    x = block[at:at + rows]
                    near, least = _nearest(x, models)
                    cost += least.sum(axis=0)
                    for r in range(m):
                        order = np.argsort(near[:, r], kind="stable")
                        own, first, n = np.unique(near[order, r], return_index=True, return_counts=True)
                        sums[r, own] += np.add.reduceat(x[order], first, axis=0)
                        counts[r, own] += n
            yield sums, counts, cost

        sums, counts, cost = blocks.mapPartitions(step).treeReduce(lambda a, b: tuple(p + q for p, q in zip(a, b)))
        shared.destroy()
        costs[live] = cost
        found = counts > 0
        moved = np.where(found[:, :, None], sums / np.maximum(counts, 1.0)[:, :, None], centres[live])
        still = (((moved - centres[live]) ** 2).sum(axis=2) > 1e-8).any(axis=1)
        centres[live] = moved
        live = live[still]
        if not len(live):
            break
    blocks.unpersist()
    return centres[int(np.argmin(costs))].reshape(k, -1)


def _assigned(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    """(id, cluster_id): the nearest centre of every vector."""
    rows = max(_CELLS // len(centres), 1)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                x = np.asarray(part.column("embedding").flatten(), dtype=np.float64).reshape(part.num_rows, -1)
                near = _nearest(x, centres[None])[0][:, 0].astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(near)], names=["id", "cluster_id"])

    schema = StructType([vectors.schema["id"], StructField("cluster_id", IntegerType())])
    wide = vectors.select("id", F.col("embedding").cast("array<double>").alias("embedding"))
    return wide.mapInArrow(run, schema)


def fit_clusters(
    vectors: DataFrame, cfg: ScreeningConfig, k: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """K-means over (id, embedding): returns (id, cluster_id) and (cluster_id, centroid, size).
    Of several seeded restarts, which share their passes over the points, the one with the least within-cluster
    cost is kept."""
    points = vectors.select("id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    points.persist(StorageLevel.MEMORY_AND_DISK)
    rows = points.count()
    k = min(k, rows) if k else cluster_count(rows, cfg)
    # no iteration: the centres that k-means|| starts from
    starts = [
        np.array(KMeans(k=k, seed=cfg.kmeans_seed + restart, maxIter=0).fit(points).clusterCenters())
        for restart in range(cfg.kmeans_restarts)
    ]
    best = _fit_together(_blocks(points), starts, cfg)
    points.unpersist()
    assigned = _assigned(vectors, best)
    # at most max_clusters rows of fitted centres, already driver-held by the model
    centres = vectors.sparkSession.createDataFrame(
        [(i, [float(x) for x in c]) for i, c in enumerate(best)],
        "cluster_id int, centroid array<float>",
    )
    centroids = centres.join(cluster_sizes(assigned), "cluster_id", "left").withColumn(
        "size", F.coalesce("size", F.lit(0).cast("long"))
    )
    return assigned, centroids


def cluster_sizes(rows: DataFrame) -> DataFrame:
    return (
        rows.filter(F.col("cluster_id").isNotNull()).groupBy("cluster_id").agg(F.count("*").alias("size"))
    )
