"""Unit vectors and the inner-product kernel shared by neighbour search and cluster assignment."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


_QUERIES = 256  # queries whose products with a wide table are made together,
_PIECE = 1 << 19  # so many at a time


def unit(c: Column) -> Column:
    """Divide by the Euclidean length; a zero vector stays zero. Stored as 32-bit floats."""
    return F.aggregate(
        c,
        F.lit(0.0),
        lambda acc, x: acc + x.cast("double") * x.cast("double"),
        lambda total: F.transform(
            c,
            lambda x: F.coalesce(F.try_divide(x.cast("double"), F.sqrt(total)), F.lit(0.0)).cast("float"),
        ),
    )


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list<float> Arrow column as an (n, d) float32 matrix without per-row objects. Nulls and rows of other
    lengths are refused, as they would shift every later vector."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if column.null_count or column.flatten().null_count or len(set(pc.list_value_length(column).to_pylist())) > 1:
        raise ValueError("vectors of a block must be of one length, without nulls")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False)
    return flat.reshape(n, -1) if n else np.empty((0, 0), dtype=np.float32)


def _exact_dots(q: np.ndarray, c: np.ndarray, rows: np.ndarray, cols: np.ndarray, pairs: int = 1 << 11) -> np.ndarray:
    """Double-precision inner products accumulated in index order, so every plan, block shape and
    engine gives the same bits for the same pair."""
    out = np.zeros(len(rows))
    for at in range(0, len(rows), pairs):
        products = q[rows[at:at + pairs]].astype(np.float64)
        products *= c[cols[at:at + pairs]]
        total = out[at:at + pairs]
        for part in products.T:
            total += part
    return out


def _near_best(rough: np.ndarray, k: int, slack: float, sample: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of whatever lies within ``slack`` of its row's k-th largest value. In a wide matrix the k-th
    largest of every ``sample``-th column, which that of all cannot fall below, leaves few values to rank; not so
    where values may be NaN (``sample`` 0)."""
    n = rough.shape[1]
    if n <= k:
        return tuple(a.ravel() for a in np.indices(rough.shape))
    wide = sample > 0 and n >= 32 * sample * k
    some = rough[:, ::sample] if wide else rough
    at = some.shape[1] - k
    bar = np.partition(some, at, axis=1)[:, at] - slack
    rows, cols = np.divmod(np.flatnonzero(rough >= bar[:, None]), n)
    if not wide:
        return rows, cols
    keep = _among_best(rows, rough[rows, cols], len(rough), k, slack)
    return rows[keep], cols[keep]


def _among_best(rows: np.ndarray, values: np.ndarray, n: int, k: int, slack: float) -> np.ndarray:
    """Which values lie within ``slack`` of the k-th largest of their row; ``rows`` ascend to ``n``, k values a row at least."""
    counts = np.bincount(rows, minlength=n)
    place = np.arange(len(rows)) - (np.cumsum(counts) - counts)[rows]
    ranked = np.full((n, int(counts.max())), -np.inf, dtype=values.dtype)
    ranked[rows, place] = values
    at = ranked.shape[1] - k
    return values >= (np.partition(ranked, at, axis=1)[:, at] - slack)[rows]


def _few_places(flags: np.ndarray) -> np.ndarray:
    """``flatnonzero`` where few are set: eight at a time are looked at first."""
    flat = flags.ravel()
    even = len(flat) - len(flat) % 8
    some = np.flatnonzero(flat[:even].view(np.uint64) != 0)
    at, place = np.divmod(np.flatnonzero(flat[:even].reshape(-1, 8)[some]), 8)
    return np.concatenate((some[at] * 8 + place, even + np.flatnonzero(flat[even:])))


def _near_best_products(q: np.ndarray, c: np.ndarray, k: int, slack: float, room: np.ndarray, sample: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """:func:`_near_best` of the products of all rows of ``q`` and ``c``, for finite values. Those of every ``sample``-th row of ``c`` set
    a bar, then the product is made in pieces of the size of ``room``, of which only what passes the bar is kept."""
    some = q @ c[::sample].T
    at = some.shape[1] - k
    bar = (np.partition(some, at, axis=1)[:, at] - slack)[:, None]
    found, width = [], max(len(room) // len(q), 1)
    for lo in range(0, len(c), width):
        part = c[lo:lo + width]
        piece = np.matmul(q, part.T, out=room[:len(q) * len(part)].reshape(len(q), len(part)))
        passed = _few_places(piece >= bar)
        rows, cols = np.divmod(passed, len(part))
        found.append((rows, cols + lo, piece.ravel()[passed]))
    rows, cols, values = (np.concatenate(p) for p in zip(*found))
    order = np.argsort(rows, kind="stable")
    rows, cols = rows[order], cols[order]
    keep = _among_best(rows, values[order], len(q), k, slack)
    return rows[keep], cols[keep]


def _distinct_rows(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    packed = np.ascontiguousarray(m).view(np.dtype((np.void, m.dtype.itemsize * m.shape[1]))).ravel()
    _, first, inverse = np.unique(packed, return_index=True, return_inverse=True)
    return first, inverse.ravel()


def best_by_inner_product(
    queries: np.ndarray, corpus: np.ndarray, ids: np.ndarray, k: int, budget: int = 1 << 22
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, id, similarity) of each query's k best corpus vectors, ties by lower id.

    A matrix product in single precision only selects: whatever lies within its error bound of the
    k-th value is measured again exactly. Equal vectors are measured once, on either side.
    """
    empty = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0)
    if not len(queries) or not len(corpus):
        return empty
    q_first, q_of = _distinct_rows(queries)
    c_first, c_of = _distinct_rows(corpus)
    q, c = queries[q_first], corpus[c_first]
    # ids grouped by distinct vector, ascending; ranks past k inside one group can never be used
    order = np.lexsort((ids, c_of))
    sizes = np.bincount(c_of, minlength=len(c))
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    usable = np.minimum(sizes, k)

    scale = max(float(np.abs(q).sum(axis=1).max()) * float(np.abs(c).max(initial=0.0)), 1e-30)
    slack = 4.0 * q.shape[1] * np.finfo(np.float32).eps * scale
    sample = 8 if np.isfinite(q).all() and np.isfinite(c).all() else 0
    out_q, out_id, out_sim = [], [], []
    wide = sample > 0 and len(c) >= 32 * sample * k
    step = min(max(1, budget // len(c)), len(q)) if not wide else min(max(1, min(_QUERIES, budget * sample // len(c))), len(q))
    room = np.empty(_PIECE if wide else step * len(c), dtype=np.float32)
    for lo in range(0, len(q), step):
        part = q[lo:lo + step]
        if wide:
            rows, cols = _near_best_products(part, c, k, slack, room, sample)
        else:
            rows, cols = _near_best(np.matmul(part, c.T, out=room[:len(part) * len(c)].reshape(len(part), -1)), k, slack, sample)
        sims = _exact_dots(part, c, rows, cols)
        by = np.lexsort((-sims, rows))
        rows, cols, sims = rows[by], cols[by], sims[by]
        # keep a vector only if fewer than k ids lie strictly above its similarity
        n = len(rows)
        new_row = np.r_[True, rows[1:] != rows[:-1]]
        new_tie = new_row | np.r_[True, sims[1:] != sims[:-1]]
        before = np.cumsum(usable[cols]) - usable[cols]
        row_start = np.maximum.accumulate(np.where(new_row, np.arange(n), 0))
        tie_start = np.maximum.accumulate(np.where(new_tie, np.arange(n), 0))
        keep = before[tie_start] - before[row_start] < k
        rows, cols, sims = rows[keep], cols[keep], sims[keep]
        # spread to ids, then cut each query at k
        times = usable[cols]
        rows, sims = np.repeat(rows, times), np.repeat(sims, times)
        offset = np.arange(len(rows)) - np.repeat(np.cumsum(times) - times, times)
        got = ids[order[np.repeat(starts[cols], times) + offset]]
        by = np.lexsort((got, -sims, rows))
        rows, sims, got = rows[by], sims[by], got[by]
        first = np.r_[True, rows[1:] != rows[:-1]] if len(rows) else np.empty(0, dtype=bool)
        place = np.arange(len(rows)) - np.maximum.accumulate(np.where(first, np.arange(len(rows)), 0))
        keep = place < k
        out_q.append(rows[keep] + lo)
        out_id.append(got[keep])
        out_sim.append(sims[keep])
    dq, did, dsim = np.concatenate(out_q), np.concatenate(out_id), np.concatenate(out_sim)
    if len(q) == len(queries) and np.array_equal(q_of, np.arange(len(q))):
        return dq, did, dsim
    # hand every query its distinct vector's result
    counts = np.bincount(dq, minlength=len(q))
    begin = np.concatenate(([0], np.cumsum(counts)[:-1]))
    times = counts[q_of]
    pick = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(begin[q_of], times)
    return np.repeat(np.arange(len(queries)), times), did[pick], dsim[pick]
