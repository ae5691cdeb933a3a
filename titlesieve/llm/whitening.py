"""Whitening by Chebyshev-filtered subspace iteration.

The covariance matrix V is never formed. A pass over the table multiplies the centred rows X with a block Q of
a few dozen directions and adds up XᵀXQ / n, a block of the same shape. A polynomial of V takes such a pass per
degree: Chebyshev's, by its three-term recurrence, stays below one on the unwanted part of the spectrum and
grows steeply above it, so a filtered block turns towards the leading eigenvectors. QR makes it orthonormal
again, one more pass gives its Rayleigh quotient and, at once, the residual of each Ritz vector. The upper end
of the unwanted part is the block's least Ritz value; the lower end comes from a few Lanczos steps, which ride
along in the first passes as one more column. Filtering goes on until every wanted Ritz pair is certified: its
residual, a bound on the distance to an eigenvalue, is down to rounding.

Rows are integers floor(64 c) + 1000000: sums are exact, and rows are centred exactly, as n x - S, before
anything is multiplied, so the large offset costs no digit.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .vectors import common_length, finite, matrix, of_length, slices

_RANGE = 65536.0  # components up to this size leave n x - S within a long for 10^12 rows
_LONG = 2**63
_LINE = "i long, line binary"


@dataclass(frozen=True)
class Whitening:
    components: int = 32
    extra: int = 16  # directions of the block beyond the wanted ones
    degree: int = 10
    lanczos: int = 8  # steps for the lower end of the spectrum
    residual: float = 2e-13  # times the largest eigenvalue
    stalled: float = 1e-10  # what counts as certified once rounding stops all progress
    rank: float = 1e-12  # share of the largest eigenvalue below which a component has no variance
    scale: int = 64
    shift: int = 1_000_000
    seed: int = 13


def _integers(column: pa.Array, cfg: Whitening) -> np.ndarray:
    return np.floor(cfg.scale * matrix(column)).astype(np.int64) + cfg.shift


def _lines(at: np.ndarray, block: np.ndarray) -> pa.RecordBatch:
    """Numbered lines of a matrix."""
    return pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array([r.tobytes() for r in block], pa.binary())], names=["i", "line"])


class Rows:
    """The fit list: all usable rows, their number, exact sums and the passes over them."""

    def __init__(self, vectors: DataFrame, cfg: Whitening):
        good = vectors.filter(finite(F.col("embedding")) & F.forall("embedding", lambda v: F.abs(v) < _RANGE))
        self.cfg, self.length = cfg, common_length(good)
        self.rows = of_length(good, self.length).select("vec_id", "embedding")
        self.n, self.sums = self._totals()

    def _totals(self) -> tuple[int, np.ndarray]:
        cfg, length = self.cfg, self.length

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, total = 0, np.zeros(length, dtype=np.int64)
            for batch in slices(batches, length):
                x = _integers(batch.column(0), cfg)
                n += len(x)
                total += x.sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total), pa.array([n] * len(total), pa.int64())], names=["i", "total", "n"])

        told = self.rows.select("embedding").mapInArrow(run, "i long, total long, n long")
        told = told.groupBy("i").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).orderBy("i").collect()
        return (told[0]["n"] if told else 0), np.array([r["total"] for r in told], dtype=np.int64)

    def added(self, kernel, shape: tuple[int, int]) -> np.ndarray:
        """The sum of ``kernel`` (from centred rows to a matrix of ``shape``) over slices of all rows, divided by n.
        Each task sends its partial sum line by line; lines are added up where they meet, and only the sum is collected."""
        cfg, length, sums, n = self.cfg, self.length, self.sums, self.n

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(shape)
            for batch in slices(batches, length):
                total += kernel((n * _integers(batch.column(0), cfg) - sums) / n)
            yield _lines(np.arange(shape[0]), total)

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, np.ndarray] = {}
            for batch in batches:
                for i, line in zip(batch.column(0).to_pylist(), batch.column(1)):
                    total[i] = total.get(i, 0.0) + np.frombuffer(line.as_buffer())
            yield _lines(np.array(sorted(total), dtype=np.int64), np.array([total[i] for i in sorted(total)]).reshape(len(total), shape[1]))

        parts = self.rows.select("embedding").mapInArrow(run, _LINE)
        out = np.zeros(shape)
        for r in parts.repartition("i").mapInArrow(add, _LINE).collect():
            out[r["i"]] = np.frombuffer(r["line"])
        return out / n

    def times(self, block: np.ndarray) -> np.ndarray:
        """V times ``block``, in one pass."""
        return self.added(lambda x: x.T @ (x @ block), block.shape)


@dataclass(frozen=True)
class Spectrum:
    """Leading eigenvalues, eigenvectors (columns), the trace of V, certified residuals and the passes taken."""

    values: np.ndarray
    vectors: np.ndarray
    trace: float
    residuals: np.ndarray
    passes: int


def _turned(block: np.ndarray, product: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rayleigh-Ritz within an orthonormal block: falling Ritz values, Ritz vectors and V times them."""
    small = block.T @ product
    values, turn = np.linalg.eigh((small + small.T) / 2)
    turn = turn[:, ::-1]
    return values[::-1], block @ turn, product @ turn


def _lowest(alpha: list[float], beta: list[float]) -> float:
    """From a Lanczos run, an estimate from below of the least eigenvalue; V has none below zero."""
    values, turn = np.linalg.eigh(np.diag(alpha) + np.diag(beta[:-1], 1) + np.diag(beta[:-1], -1))
    return max(0.0, float(values[0] - abs(beta[-1] * turn[-1, 0])))


def leading(rows: Rows, cfg: Whitening) -> Spectrum:
    """The leading eigenpairs of the covariance of ``rows`` by filtered subspace iteration."""
    d = rows.length
    wanted = min(cfg.components, d)
    size = min(wanted + cfg.extra, d)
    draw = np.random.default_rng(cfg.seed)
    block, _ = np.linalg.qr(draw.standard_normal((d, size)))
    walk, last = draw.standard_normal(d), np.zeros(d)
    walk /= np.linalg.norm(walk)
    alpha: list[float] = []
    beta: list[float] = []
    trace = rows.added(lambda x: np.array([[(x * x).sum()]]), (1, 1))[0, 0]
    passes, before = 1, np.inf

    def times(q: np.ndarray) -> np.ndarray:
        nonlocal passes, walk, last
        passes += 1
        if len(alpha) == cfg.lanczos or size == d:
            return rows.times(q)
        out = rows.times(np.column_stack([q, walk]))  # a Lanczos step rides along
        step = out[:, -1] - (beta[-1] if beta else 0.0) * last
        alpha.append(float(step @ walk))
        step -= alpha[-1] * walk
        beta.append(float(np.linalg.norm(step)))
        last, walk = walk, step / beta[-1] if beta[-1] > 0 else np.zeros(d)
        return out[:, :-1]

    while True:
        values, block, product = _turned(block, times(block))
        residuals = np.linalg.norm(product - block * values, axis=0)[:wanted]
        worst, top = residuals.max(initial=0.0), max(values[0], 0.0) if size else 0.0
        if size == d or worst <= cfg.residual * top or worst <= cfg.stalled * top and worst > before / 2:
            return Spectrum(values[:wanted], block[:, :wanted], trace, residuals, passes)
        before = worst
        # damp [low, high], the part below the block
        high = values[-1]
        low = min(_lowest(alpha, beta), 0.99 * high) if len(alpha) == cfg.lanczos else 0.0
        centre, half = (high + low) / 2, max((high - low) / 2, 1e-3 * top)
        older, newer = block, (product - centre * block) / half
        for _ in range(cfg.degree - 1):
            older, newer = newer, 2 * (times(newer) - centre * newer) / half - older
            size_of = np.linalg.norm(newer, axis=0).max()
            older, newer = older / size_of, newer / size_of
        block, _ = np.linalg.qr(newer)


def whitened(vectors: DataFrame, cfg: Whitening = Whitening()) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error, from vec_id and embedding (nothing
    else is read): for each usable row and component the row's centred projection over the component's standard
    deviation.

    Dropped are vectors that are null, empty or hold null or non-finite entries, vectors of another length than
    the one of the smallest vec_id, and those with an entry of 65,536 or more. Repeated rows count and come out as
    often as they are there; null ids stay. Components without variance (at most ``rank`` of the largest
    eigenvalue: equal vectors, fewer rows than components) have no rows. A deviation beyond a long is null. An
    empty table gives an empty result.
    """
    rows = Rows(vectors, cfg)
    found = leading(rows, cfg) if rows.n else Spectrum(np.empty(0), np.empty((0, 0)), 0.0, np.empty(0), 0)
    keep = found.values > cfg.rank * max(found.values[0], 0.0) if len(found.values) else np.empty(0, dtype=bool)
    keep &= found.values > 0
    values, n, sums, length = found.values[keep], rows.n, rows.sums, rows.length
    onto = found.vectors[:, keep] / np.sqrt(values) if len(values) else np.empty((length, 0))
    explained, k = values / found.trace if len(values) else values, len(values)

    def moments(x: np.ndarray) -> np.ndarray:
        w = x @ onto
        return w.T @ w

    error = float(np.abs(rows.added(moments, (k, k)) - np.eye(k)).max()) if k else 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, length + 8 * k):
            away = n * _integers(batch.column("embedding"), cfg) - sums
            if np.abs(away).max(initial=0) < (_LONG // max(length, 1)) ** 0.5:
                square = pa.array((away * away).sum(axis=1))
            else:
                exact = [sum(int(a) ** 2 for a in r) for r in away]
                square = pa.array([s if s < _LONG else None for s in exact], pa.int64())
            at = np.repeat(np.arange(len(away)), k)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").take(pa.array(at)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(away))),
                 pa.array(np.full(len(at), n, dtype=np.int64)), square.take(pa.array(at)), pa.array((away / n @ onto).ravel()),
                 pa.array(np.tile(explained, len(away))), pa.array(np.full(len(at), error))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    kind = T.StructType([rows.rows.schema["vec_id"], *(T.StructField(c, t) for c, t in (
        ("component", T.IntegerType()), ("n", T.LongType()), ("deviation", T.LongType()), ("whitened", T.DoubleType()),
        ("explained", T.DoubleType()), ("identity_error", T.DoubleType())))])
    return rows.rows.mapInArrow(run, kind)


def op13(vectors: DataFrame) -> DataFrame:
    return whitened(vectors)
