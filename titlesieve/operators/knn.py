"""Exact nearest neighbours by inner product of unit vectors.

An index is one cell until it is so large that every cell would fill a block. It is then cut by the
cluster model into cells (centroid, ring of angles around it); the triangle inequality on angles bounds what a cell can offer, so a proposal
first searches the cells most promising to it and then only those that could still beat its k-th
similarity. Nothing is approximated: a cell is skipped only when its bound rules it out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import ScreeningConfig
from ..functions.vectors import best_by_inner_product, matrix
from ..session import cut_lineage
from .blocks import block_product, whole_product

_MAX_RINGS = 32
_CHUNK = 64  # queries whose bounds against all cells are held at once
_HITS = "proposal_id long, id long, similarity double"


def _kernel(k: int):
    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        owners = left.column("proposal_id").to_numpy()
        rows, ids, sims = best_by_inner_product(
            matrix(left.column("embedding")), matrix(right.column("embedding")), right.column("id").to_numpy(), k
        )
        return pa.table({
            "proposal_id": pa.array(owners[rows], pa.int64()),
            "id": pa.array(ids, pa.int64()),
            "similarity": pa.array(sims, pa.float64()),
        })

    return search


def top_hits(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("proposal_id").orderBy(F.desc("similarity"), F.asc("id"))
    return hits.withColumn("sem_rank", F.row_number().over(order)).filter(F.col("sem_rank") <= k)


def nearest_neighbours(
    proposals: DataFrame,
    vectors: DataFrame,
    k: int,
    cfg: ScreeningConfig,
    model: np.ndarray | None = None,
    prune_from: int | None = None,
) -> DataFrame:
    """(proposal_id, id, similarity, sem_rank): the k most similar vectors of each proposal,
    ties by id. Both inputs carry unit vectors in ``embedding``; ``model`` holds the centroids.
    Pruning starts at ``prune_from`` rows, by default one block per centroid, below which visiting
    cells could only cost more than visiting all blocks."""
    queries = proposals.select("proposal_id", "embedding")
    index = vectors.select("id", "embedding")
    if model is not None and len(model):
        rows = index.count()
        if rows > (cfg.corpus_block_rows * len(model) if prune_from is None else prune_from):
            rings = int(min(max(rows // (cfg.corpus_block_rows * len(model)), 1), _MAX_RINGS))
            return top_hits(_pruned(queries, index, k, cfg, _unit_rows(model), rings), k)
    hits = whole_product(
        queries, index, "proposal_id", "id", cfg.proposal_block_rows, cfg.corpus_block_rows, _kernel(k), _HITS
    )
    return top_hits(hits, k)


def nearest_by_scan(proposals: DataFrame, vectors: DataFrame, k: int, cfg: ScreeningConfig) -> DataFrame:
    """The same for a batch of at most ``small_batch_rows`` proposals: their vectors go to the tasks that scan the
    index, which is not shuffled; each task sends its k best only."""
    asked = proposals.select("proposal_id", "embedding").limit(cfg.small_batch_rows + 1).collect()
    if len(asked) > cfg.small_batch_rows:
        raise ValueError(f"more than {cfg.small_batch_rows} proposals")
    owners = np.array([r["proposal_id"] for r in asked], dtype=np.int64)
    queries = np.array([r["embedding"] for r in asked], dtype=np.float32).reshape(len(asked), -1)

    def run(batches):
        held = [np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0)]
        for batch in batches:
            found = best_by_inner_product(queries, matrix(batch.column("embedding")), batch.column("id").to_numpy(), k)
            rows, ids, sims = (np.concatenate(p) for p in zip(held, found))
            order = np.lexsort((ids, -sims, rows))
            rows = rows[order]
            starts = np.searchsorted(rows, rows)
            keep = np.arange(len(rows)) - starts < k
            held = [rows[keep], ids[order][keep], sims[order][keep]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(owners[held[0]], pa.int64()), pa.array(held[1], pa.int64()), pa.array(held[2], pa.float64())],
            names=["proposal_id", "id", "similarity"])

    return top_hits(vectors.select("id", "embedding").mapInArrow(run, _HITS), k)


def _product(queries: DataFrame, index: DataFrame, k: int, cfg: ScreeningConfig) -> DataFrame:
    return block_product(
        queries, index, "cell", "proposal_id", "id",
        cfg.proposal_block_rows, cfg.corpus_block_rows, _kernel(k), _HITS,
    )


def _angles(vectors: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """Angles in double precision from the distance of the normalised rows, 2 arcsin(|a - b| / 2): unlike the
    arc cosine of a product it loses nothing near 0, where queries lie that are close to a centroid."""
    a, b = _unit_rows(vectors), _unit_rows(directions)
    out = np.empty((len(a), len(b)))
    for j, centre in enumerate(b):
        apart = a - centre
        out[:, j] = 2 * np.arcsin(np.minimum(np.sqrt(np.einsum("ij,ij->i", apart, apart)) / 2, 1.0))
    return out


def _unit_rows(model: np.ndarray) -> np.ndarray:
    model = np.asarray(model, dtype=np.float64)
    lengths = np.linalg.norm(model, axis=1, keepdims=True)
    return np.divide(model, lengths, out=np.zeros_like(model), where=lengths > 0)


def _slack(dimension: int) -> float:
    """What a ceiling must allow for: stored unit vectors are rounded to single precision, so a product of
    two differs from the cosine of their angle by up to the rounding of their lengths (d ulps of single
    precision, both sides); the angles themselves are exact to a few ulps of double precision."""
    return 4 * (dimension + 4) * float(np.finfo(np.float32).eps)


def assign_cells(index: DataFrame, directions: np.ndarray, rings: int) -> DataFrame:
    """Cell of each vector (nearest centroid and ring around it; -1 for zero vectors) and its angle
    to that centroid."""

    def run(batches):
        for batch in batches:
            m = matrix(batch.column("embedding"))
            out, away = np.full(len(m), -1, dtype=np.int32), np.zeros(len(m))
            live = np.nonzero(m.any(axis=1))[0] if len(m) else np.empty(0, dtype=np.int64)
            if len(live):
                angle = _angles(m[live], directions)
                near = angle.argmin(axis=1)
                away[live] = angle[np.arange(len(live)), near]
                ring = (away[live] * (rings / np.pi)).astype(np.int32)
                out[live] = near * rings + np.minimum(ring, rings - 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("embedding"), pa.array(out), pa.array(away)],
                names=["id", "embedding", "cell", "angle"],
            )

    return index.mapInArrow(run, "id long, embedding array<float>, cell int, angle double")


class Cells:
    """The cells of an index with their size and the range of angles they really hold."""

    def __init__(self, directions: np.ndarray, rings: int, stats: list):
        self.directions = directions
        self.ids = np.array([r["cell"] for r in stats], dtype=np.int32)
        self.counts = np.array([r["n"] for r in stats], dtype=np.int64)
        self.low = np.array([r["low"] for r in stats], dtype=np.float64)
        self.high = np.array([r["high"] for r in stats], dtype=np.float64)
        self.centre = np.maximum(self.ids, 0) // rings

    def ceilings(self, queries: np.ndarray) -> np.ndarray:
        """Highest similarity any vector of each cell could have with each query."""
        angle, slack = _angles(queries, self.directions)[:, self.centre], _slack(queries.shape[1])
        bound = np.cos(np.clip(np.maximum(angle - self.high, self.low - angle), 0.0, np.pi)) + slack
        bound[~queries.any(axis=1)] = slack
        bound[:, self.ids < 0] = slack
        return bound

    def opening(self, bound: np.ndarray, k: int) -> np.ndarray:
        """The best cells by bound that together hold at least k vectors."""
        order = np.argsort(-bound, axis=1, kind="stable")
        before = np.cumsum(self.counts[order], axis=1) - self.counts[order]
        chosen = np.zeros(bound.shape, dtype=bool)
        np.put_along_axis(chosen, order, before < k, axis=1)
        return chosen


def _visits(queries: DataFrame, decide) -> DataFrame:
    """Spread each query to the cells ``decide`` picks for it."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, _CHUNK):
                part = batch.slice(at, _CHUNK)
                rows, cells = decide(part)
                picked = part.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays(
                    [picked.column("proposal_id"), picked.column("embedding"), pa.array(cells, pa.int32())],
                    names=["proposal_id", "embedding", "cell"],
                )

    return queries.mapInArrow(run, "proposal_id long, embedding array<float>, cell int")


def _pruned(
    queries: DataFrame, index: DataFrame, k: int, cfg: ScreeningConfig, directions: np.ndarray, rings: int
) -> DataFrame:
    # read by the statistics and by both products: assigned once
    celled = cut_lineage(assign_cells(index, directions, rings))
    # at most max_model_rows * _MAX_RINGS + 1 rows of four numbers
    stats = celled.groupBy("cell").agg(
        F.count("*").alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high")
    ).collect()
    cells, celled = Cells(directions, rings, stats), celled.drop("angle")

    def first(batch):
        bound = cells.ceilings(matrix(batch.column("embedding")))
        rows, cols = np.nonzero(cells.opening(bound, k))
        return rows, cells.ids[cols]

    def second(batch):
        bound = cells.ceilings(matrix(batch.column("embedding")))
        floor = batch.column("floor").to_numpy(zero_copy_only=False)
        rows, cols = np.nonzero((bound >= floor[:, None]) & ~cells.opening(bound, k))
        return rows, cells.ids[cols]

    # read twice below, and costly: cut the lineage so that it is searched once
    opened = cut_lineage(_product(_visits(queries, first), celled, k, cfg))
    floors = (
        top_hits(opened, k)
        .groupBy("proposal_id")
        .agg(F.when(F.count("*") >= k, F.min("similarity")).otherwise(F.lit(-2.0)).alias("floor"))
    )
    rest = _visits(queries.join(floors, "proposal_id"), second)
    return opened.unionByName(_product(rest, celled, k, cfg))
