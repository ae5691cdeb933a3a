"""Approximate nearest neighbours by collision counting on single projections.

An index block keeps, for each random projection, its vectors sorted by that projection. Around a query's own
value a window opens on every sorted array; a vector inside it collides once. Windows are widened step by
step (virtual rehashing), counts carry on, and a vector whose collisions reach the threshold is verified by
its exact cosine. A query stops once a vector as near as its k-th best so far would have been verified with
the wanted confidence, whatever share of the block that takes; there is no cap on candidates.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import erf, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.blocks import block_product


@dataclass(frozen=True)
class Collisions:
    k: int = 5
    projections: int = 64
    threshold: float = 0.5  # share of the projections on which a vector must collide
    confidence: float = 2.33  # standard deviations that a k-th neighbour's collisions lie above the threshold
    first: float = 0.35  # half width of the first windows, for unit vectors
    widen: float = 1.2
    steps: int = 16  # the last window takes everything
    query_rows: int = 8192
    index_rows: int = 32768
    seed: int = 17


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of equally long lists without nulls."""
    lists = column.combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)


class Block:
    """Sorted projections of a block of vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, cfg: Collisions):
        self.cfg, self.ids, self.vectors = cfg, ids, vectors
        self.lengths = np.sqrt((vectors * vectors).sum(axis=1))
        draw = np.random.default_rng(cfg.seed).standard_normal((vectors.shape[1], cfg.projections))
        self.draw = draw
        values = ((vectors / self.lengths[:, None]) @ draw).T
        self.order = np.argsort(values, axis=1, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(values, self.order, axis=1)

    def search(self, ids: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row of the query, id and cosine of its k best here, ties to the smaller id."""
        cfg, n = self.cfg, len(self.ids)
        lengths = np.sqrt((queries * queries).sum(axis=1))
        at = (queries / lengths[:, None]) @ self.draw
        widths = np.append(cfg.first * cfg.widen ** np.arange(cfg.steps), np.inf)
        low = np.stack([np.searchsorted(s, a[:, None] - widths) for s, a in zip(self.sorted, at.T)])
        high = np.stack([np.searchsorted(s, a[:, None] + widths, side="right") for s, a in zip(self.sorted, at.T)])
        need = cfg.threshold * cfg.projections
        sure = cfg.threshold + cfg.confidence * sqrt(cfg.threshold * (1 - cfg.threshold) / cfg.projections)
        rows, found, scores = [], [], []
        for q in range(len(queries)):
            counts, open_ = np.zeros(n, dtype=np.int32), self.ids != ids[q]
            best, score = np.empty(0, dtype=np.int64), np.empty(0)
            for step, width in enumerate(widths):
                lo, hi = low[:, q, step], high[:, q, step]
                if step:
                    parts = [o[a:b] for o, a, b in zip(self.order, lo, low[:, q, step - 1])]
                    parts += [o[a:b] for o, a, b in zip(self.order, high[:, q, step - 1], hi)]
                else:
                    parts = [o[a:b] for o, a, b in zip(self.order, lo, hi)]
                counts += np.bincount(np.concatenate(parts), minlength=n).astype(np.int32)
                new = np.flatnonzero((counts >= need) & open_)
                if len(new):
                    open_[new] = False
                    # row sums, not a matrix product: equal vectors get equal scores wherever they lie
                    cosine = (self.vectors[new] * queries[q]).sum(axis=1) / (self.lengths[new] * lengths[q])
                    best, score = np.concatenate([best, self.ids[new]]), np.concatenate([score, cosine])
                    keep = np.lexsort((best, -score))[: cfg.k]
                    best, score = best[keep], score[keep]
                if len(best) == cfg.k:
                    away = sqrt(max(2 - 2 * score[-1], 0.0))
                    if away == 0 or erf(width / (away * sqrt(2))) >= sure:
                        break
            rows.append(np.full(len(best), q))
            found.append(best)
            scores.append(score)
        return np.concatenate(rows), np.concatenate(found), np.concatenate(scores)


def usable(vectors: DataFrame) -> DataFrame:
    """Rows with an id and a vector that is not null, empty or zero and has only finite components."""
    x = F.col("embedding")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vectors.select("vec_id", "embedding").filter(
        F.col("vec_id").isNotNull() & x.isNotNull() & ~bad & F.exists(x, lambda v: v != 0))


def nearest(queries: DataFrame, vectors: DataFrame, cfg: Collisions = Collisions()) -> DataFrame:
    """query_id, rank (from 1), vec_id and score (cosine in double precision): the k nearest of ``vectors``
    (vec_id, embedding) to each of ``queries`` (the same columns), rows of the query's own id apart; fewer
    if there are fewer.

    Unusable vectors (see ``usable``) take no part, and vectors only meet others of their length. A query id
    that comes several times is asked once, with the least of its vectors. Repeated candidate rows count
    each. Every block of queries meets every block of vectors; neither table is ever held whole.
    """
    dim = F.size("embedding").alias("dim")
    asked = usable(queries).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    asked = asked.select(F.col("vec_id").alias("query_id"), "embedding", dim)
    rows = usable(vectors).select("vec_id", "embedding", dim, F.monotonically_increasing_id().alias("row"))

    def kernel(left: pa.Table, right: pa.Table) -> pa.Table:
        kind = {"query_id": pa.int64(), "vec_id": pa.int64(), "score": pa.float64()}
        if not len(left) or not len(right):
            return pa.table({n: pa.array([], t) for n, t in kind.items()})
        ids = left.column("query_id").to_numpy()
        block = Block(right.column("vec_id").to_numpy(), _matrix(right.column("embedding")), cfg)
        rows, found, scores = block.search(ids, _matrix(left.column("embedding")))
        return pa.table({"query_id": pa.array(ids[rows], pa.int64()), "vec_id": pa.array(found, pa.int64()), "score": pa.array(scores, pa.float64())})

    hits = block_product(asked, rows, "dim", "query_id", "row", cfg.query_rows, cfg.index_rows, kernel,
                         "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= cfg.k).select("query_id", "rank", "vec_id", "score")


def op9(vectors: DataFrame) -> DataFrame:
    """The contract of the query: rows whose id is divisible by 50 against all."""
    return nearest(vectors.filter("vec_id % 50 = 0"), vectors)
