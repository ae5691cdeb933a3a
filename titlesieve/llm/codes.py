"""Compression of vectors to short codes: product quantisation whose nearest entries a GNAT finds.

A vector is cut into parts; each part position has a codebook, and a part becomes the index of its nearest
entry. The entries of a codebook hang in a geometric near-neighbour access tree: a node holds a few split
points, every other entry belongs to its nearest split point, and for each split point and each child the node
keeps the least and greatest distance between them. A measured distance to one split point thus rules out
whole children: all of a child lies farther than the best entry so far if the query's distance lies outside
the child's range by more than that best. Ranges are rounded outwards, a child goes only if it is strictly too
far, and entries are compared by integer squared distances, so ties end with the lower index as in a full scan.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut
from .vectors import common_length, finite, matrix, of_length, slices

_FAR = np.iinfo(np.int64).max
_LOOSE = 2.0**-48  # share by which ranges and reaches are widened; rounding errs by less
_RANGE = 65536.0  # components up to this size have exact integers and squared distances
_LABELS = 10_000  # label sums up to this many are broadcast


@dataclass(frozen=True)
class Codes:
    parts: int = 16
    entries: int = 64
    rounds: int = 2
    scale: int = 256  # a component x becomes the integer floor(scale * x)
    fan: int = 8  # split points of a tree node


class Gnat:
    """The tree over the entries (rows of integers) of one codebook."""

    def __init__(self, entries: np.ndarray, fan: int):
        self.entries = entries
        self.root = self._grown(np.arange(len(entries)), fan)

    def _squares(self, one: int, others: np.ndarray) -> np.ndarray:
        return ((self.entries[others] - self.entries[one]) ** 2).sum(axis=1)

    def _grown(self, members: np.ndarray, fan: int):
        """(split points, least and greatest distance from split i to child j, children). The first split is the
        lowest index, each further one the entry farthest from those before."""
        splits, nearest = [int(members[0])], self._squares(members[0], members)
        while len(splits) < min(fan, len(members)):
            away = np.where(np.isin(members, splits), -1, nearest)
            splits.append(int(members[np.argmax(away)]))
            nearest = np.minimum(nearest, self._squares(splits[-1], members))
        rest = members[~np.isin(members, splits)]
        owner = np.argmin(np.stack([self._squares(s, rest) for s in splits]), axis=0) if len(rest) else np.empty(0, dtype=np.int64)
        low, high = np.full((len(splits),) * 2, np.inf), np.full((len(splits),) * 2, -np.inf)
        children = []
        for j, split in enumerate(splits):
            own = rest[owner == j]
            for i, other in enumerate(splits):
                below = own if i == j else np.append(own, split)  # a split point's range to its own child leaves itself out
                if len(below):
                    away = np.sqrt(self._squares(other, below).astype(np.float64))
                    low[i, j], high[i, j] = away.min() * (1 - _LOOSE), away.max() * (1 + _LOOSE)
            children.append(self._grown(own, fan) if len(own) else None)
        return splits, low, high, children

    def nearest(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Index and squared distance of each row's nearest entry, ties to the lower index; distances measured."""
        best, at, measured = np.full(len(asked), _FAR), np.zeros(len(asked), dtype=np.int64), 0
        columns = np.ascontiguousarray(asked.T)
        open_ = [(self.root, np.arange(len(asked)))]
        while open_:
            (splits, low, high, children), rows = open_.pop()
            own = columns[:, rows]
            alive = np.ones((len(splits), len(rows)), dtype=bool)
            for i, split in enumerate(splits):
                on = np.flatnonzero(alive[i])
                ask = rows[on]
                measured += len(ask)
                square = np.zeros(len(ask), dtype=np.int64)
                for column, value in zip(own, self.entries[split]):
                    step = column[on] - value
                    square += step * step
                before = best[ask]
                closer = (square < before) | (square == before) & (split < at[ask])
                best[ask[closer]], at[ask[closer]] = square[closer], split
                away, reach = np.sqrt(square.astype(np.float64)), np.sqrt(np.minimum(square, before).astype(np.float64))
                reach += _LOOSE * (away + reach)
                for j in range(i, len(splits)):
                    if j == i and children[j] is None:
                        continue
                    out = (away - reach > high[i, j]) | (away + reach < low[i, j])
                    alive[j, on[out]] = False
                if children[i] is not None:
                    keep = rows[on[alive[i, on]]]
                    if len(keep):
                        open_.append((children[i], keep))
        return at, best, measured


def _cuts(length: int, parts: int) -> list[int]:
    """Where the parts begin and end: equal ones where the length allows it."""
    return [length * p // parts for p in range(parts + 1)]


def _integers(vectors: np.ndarray, cfg: Codes) -> np.ndarray:
    return np.floor(cfg.scale * vectors).astype(np.int64)


def _assigned(x: np.ndarray, trees: list[Gnat], cuts: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Entry and squared distance of each vector (row) and part (column)."""
    entry, error = np.empty((len(x), len(trees)), dtype=np.int64), np.empty((len(x), len(trees)), dtype=np.int64)
    for p, tree in enumerate(trees):
        entry[:, p], error[:, p], _ = tree.nearest(np.ascontiguousarray(x[:, cuts[p]:cuts[p + 1]]))
    return entry, error


def usable(vectors: DataFrame) -> tuple[DataFrame, int]:
    """The rows that can be coded, and the length of their vectors."""
    in_range = vectors.filter(finite(F.col("embedding")) & F.forall("embedding", lambda v: F.abs(v) < _RANGE))
    length = common_length(in_range)
    return of_length(in_range, length), length


def fit(rows: DataFrame, length: int, cfg: Codes = Codes()) -> list[np.ndarray]:
    """The codebooks, one array of integer entries a part, from all ``rows`` (see ``usable``): they start as the
    parts of the rows of smallest vec_id, and each round moves every entry to the floored mean of its parts."""
    seeds = rows.orderBy(F.asc_nulls_last("vec_id"), "embedding").limit(cfg.entries).select("embedding").collect()
    cuts = _cuts(length, cfg.parts)
    first = _integers(np.array([r[0] for r in seeds], dtype=np.float64).reshape(len(seeds), length), cfg)
    books = [first[:, a:b] for a, b in zip(cuts, cuts[1:])]
    for _ in range(cfg.rounds if seeds else 0):
        books = _moved(rows, length, books, cfg)
    return books


def _moved(rows: DataFrame, length: int, books: list[np.ndarray], cfg: Codes) -> list[np.ndarray]:
    cuts, size = _cuts(length, cfg.parts), len(books[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [Gnat(b, cfg.fan) for b in books]
        count, total = np.zeros((cfg.parts, size), dtype=np.int64), np.zeros((size, length), dtype=np.int64)
        for batch in slices(batches, length):
            x = _integers(matrix(batch.column(0)), cfg)
            entry, _ = _assigned(x, trees, cuts)
            for p in range(cfg.parts):
                count[p] += np.bincount(entry[:, p], minlength=size)
                np.add.at(total[:, cuts[p]:cuts[p + 1]], entry[:, p], x[:, cuts[p]:cuts[p + 1]])
        part = np.repeat(np.arange(cfg.parts), np.diff(cuts))
        e, place = np.nonzero(count.T[:, part])
        yield pa.RecordBatch.from_arrays(
            [pa.array(e), pa.array(place), pa.array(count[part[place], e]), pa.array(total[e, place])], names=["entry", "place", "n", "total"])

    # a row for each entry and component at most, whatever the table's size
    moved = rows.select("embedding").mapInArrow(run, "entry long, place long, n long, total long")
    full = np.concatenate(books, axis=1)
    for r in moved.groupBy("entry", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():
        full[r["entry"], r["place"]] = r["total"] // r["n"]
    return [full[:, a:b] for a, b in zip(cuts, cuts[1:])]


def encode(rows: DataFrame, length: int, books: list[np.ndarray], cfg: Codes = Codes()) -> DataFrame:
    """vec_id, label, code (two hex digits a part) and error (squared distances summed over parts) of ``rows``."""
    cuts, digits = _cuts(length, cfg.parts), np.array([f"{i:02x}" for i in range(len(books[0]))] or [""], dtype="U2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = [Gnat(b, cfg.fan) for b in books] if len(books[0]) else []
        for batch in slices(batches, length):
            entry, error = _assigned(_integers(matrix(batch.column("embedding")), cfg), trees, cuts)
            code = ["".join(r) for r in digits[entry]]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(code, pa.string()), pa.array(error.sum(axis=1))],
                                             names=["vec_id", "label", "code", "error"])

    kind = T.StructType([rows.schema["vec_id"], rows.schema["label"], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    return rows.select("vec_id", "label", "embedding").mapInArrow(run, kind)


def digest(books: list[np.ndarray]) -> str:
    """Of all components in decimal, by part, entry and position."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel()).encode()).hexdigest()


def op11(vectors: DataFrame, cfg: Codes = Codes()) -> DataFrame:
    """The contract of the query, from vec_id, label and embedding (nothing else is read): vec_id, code, error,
    label_error (errors summed over equal labels, nulls together), codebooks_sha256.

    Dropped are vectors that are null, empty or hold null or non-finite components, vectors of another length
    than the one of the smallest vec_id, and those with a component of 65,536 or more, whose squared distances
    would leave a long. Repeated rows count and come out as often as they are there; null ids sort last among
    the first entries, and of equal ids the least vector comes first. Fewer rows than entries make shorter
    codebooks; an empty table gives an empty result.
    """
    rows, length = usable(vectors)
    books = fit(rows, length, cfg)
    coded = cut(encode(rows, length, books, cfg))
    sums = cut(coded.groupBy(F.col("label").alias("_l")).agg(F.sum("error").alias("label_error")))
    if sums.count() <= _LABELS:
        joined = coded.join(F.broadcast(sums), F.col("label").eqNullSafe(F.col("_l")), "left")
    else:  # labels may be uneven: each one's sum goes to several tasks
        salted = sums.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(31))))
        joined = coded.withColumn("_t", F.pmod(F.xxhash64("vec_id", "code"), F.lit(32)).cast("int")).join(
            salted, F.col("label").eqNullSafe(F.col("_l")) & (F.col("_t") == F.col("_s")), "left")
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
