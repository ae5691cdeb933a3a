"""Near duplicates among vectors by spherical-cap filters.

A filter is a direction; a vector passes it if their inner product exceeds a bound, so it holds a cap of the
sphere. Near vectors share caps and far ones hardly do. The directions are the words of random product codes:
after a random rotation the dimensions fall into blocks, each block has its own random codewords, and any
choice of one codeword a block is a filter. All filters a vector passes are decoded as a list, block by block,
keeping only prefixes that the best remaining codewords can still lift over the bound. Several small codes with
rotations of their own stand in for one large code, whose filters would depend on each other too much.

The bound is calibrated: pairs at exactly the wanted cosine are drawn and it is set so that they share
``common`` filters on average. Rotations being random, any such pair of the data stands as well as a drawn one.

Equal vectors are one class from the start. Vectors that share a filter meet in its bucket and are verified by
their cosine; a pair counts only in the first filter its members share. A bucket gives out, for each member, its
number of links there and one edge of a spanning forest, never the pairs. Large buckets are cut into blocks,
every two of which meet in a group of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import compute_tasks
from .common import cut
from .components import components
from .vectors import finite

_HOT = 1000  # a class is hot from this share (1/1000) of the rows on, so there are at most as many
_PAIRS = 1 << 19  # pairs whose products are held at once
_SLACK = 1e-9  # cosines this near the threshold are measured again, term by term


@dataclass(frozen=True)
class Caps:
    cosine: float = 0.95
    common: float = 16.0  # filters that a pair at the threshold shares on average
    codes: int = 64
    words: int | None = None  # codewords a block; None: by the number of vectors
    drawn: int = 512  # pairs of the calibration
    block_rows: int = 2048  # members of a bucket's block
    seed: int = 29

    def sized(self, n: int) -> int:
        """Codewords a block so that there are some 16 filters a vector: a power of two from 16 to 4096."""
        return self.words or int(min(max(2 ** np.ceil(np.log2(max(16 * n / self.codes, 1)) / 2), 16), 4096))


class ProductCodes:
    """The filters for vectors of one length."""

    def __init__(self, length: int, words: int, cfg: Caps):
        draw = np.random.default_rng([cfg.seed, length])
        self.words, self.length = words, length
        blocks = np.array_split(np.arange(length), 2 if length >= 8 else 1)
        # on few dimensions codewords lie dense anyway
        codes, self.words = (cfg.codes, words) if length >= 4 else (4, 16)
        self.codes = []
        for _ in range(codes):
            turn, _ = np.linalg.qr(draw.standard_normal((length, length)))
            word = [draw.standard_normal((self.words, len(b))) for b in blocks]
            word = [w / np.linalg.norm(w, axis=1, keepdims=True) / np.sqrt(len(blocks)) for w in word]
            # rotation and codewords in one matrix a block
            self.codes.append([turn[:, b] @ w.T for b, w in zip(blocks, word)])
        self.bound = self._calibrated(draw, cfg)

    def _calibrated(self, draw: np.random.Generator, cfg: Caps) -> float:
        x, z = draw.standard_normal((2, cfg.drawn, self.length))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        z -= (z * x).sum(axis=1, keepdims=True) * x
        away = np.linalg.norm(z, axis=1, keepdims=True)
        z = np.divide(z, away, out=np.zeros_like(z), where=away > 1e-9)
        y = cfg.cosine * x + np.sqrt(1 - cfg.cosine**2) * z
        y /= np.linalg.norm(y, axis=1, keepdims=True)
        wanted, low = int(cfg.common * cfg.drawn), 4 / np.sqrt(self.length)
        while True:  # from caps too small to caps that hold enough
            both = [self._least(code, x, y, low) for code in self.codes]
            both = np.concatenate(both)
            if len(both) >= wanted or low < -1:
                return float(np.sort(both)[::-1][min(wanted, len(both)) - 1]) - 1e-12
            low -= 0.25 / np.sqrt(self.length)

    @staticmethod
    def _least(code: list[np.ndarray], x: np.ndarray, y: np.ndarray, low: float) -> np.ndarray:
        """Of the filters of one code that both x and y pass at ``low``, the lesser inner product."""
        row, word, value = _listed([x @ c for c in code], low)
        other, rest = np.zeros(len(row)), word
        for c in code[::-1]:
            other += (y @ c)[row, rest % c.shape[1]]
            rest = rest // c.shape[1]
        least = np.minimum(value, other)
        return least[least >= low]

    def decode(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and number of each filter that each unit vector passes, by row and number."""
        rows, found = [], []
        for c, code in enumerate(self.codes):
            row, word, _ = _listed([unit @ m for m in code], self.bound)
            rows.append(row)
            found.append(word + c * self.words ** len(code))
        row, word = np.concatenate(rows), np.concatenate(found)
        order = np.lexsort((word, row))
        return row[order], word[order]


def _listed(parts: list[np.ndarray], bound: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, word number and inner product of every word above ``bound``, from the products by block."""
    rest = np.zeros((len(parts) + 1, len(parts[0])))
    for j in range(len(parts) - 1, -1, -1):
        rest[j] = rest[j + 1] + parts[j].max(axis=1)
    row = np.flatnonzero(rest[0] >= bound)
    value, word = np.zeros(len(row)), np.zeros(len(row), dtype=np.int64)
    for j, part in enumerate(parts):
        grown = value[:, None] + part[row]
        at, i = np.nonzero(grown >= (bound - rest[j + 1][row])[:, None])
        row, value, word = row[at], grown[at, i], word[at] * part.shape[1] + i
    return row, word, value


@lru_cache(maxsize=8)
def _codes(length: int, words: int, cfg: Caps) -> ProductCodes:
    return ProductCodes(length, words, cfg)


def _doubles(column: pa.Array, rows: np.ndarray) -> np.ndarray:
    """The equally long lists at ``rows`` as doubles."""
    taken = column.take(pa.array(rows))
    return taken.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), -1)


def _lengths(column: pa.Array) -> np.ndarray:
    return np.diff(column.offsets.to_numpy())


def filtered(classes: DataFrame, words: int, cfg: Caps) -> DataFrame:
    """cid, length and the ascending numbers of all filters that each vector passes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                piece = batch.slice(at, 512)
                vectors, long = piece.column("embedding"), _lengths(piece.column("embedding"))
                for length in np.unique(long):
                    rows = np.flatnonzero(long == length)
                    unit = _doubles(vectors, rows)
                    unit /= np.sqrt((unit * unit).sum(axis=1))[:, None]
                    row, word = _codes(int(length), words, cfg).decode(unit)
                    offsets = np.searchsorted(row, np.arange(len(rows) + 1)).astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [piece.column("cid").take(pa.array(rows)), pa.array(np.full(len(rows), length, dtype=np.int64)),
                         pa.ListArray.from_arrays(pa.array(offsets), pa.array(word, pa.int64()))], names=["cid", "length", "filters"])

    return classes.select("cid", "embedding").mapInArrow(run, "cid long, length long, filters array<long>")


# ------------------------------------------------------------------ verification within buckets

class _Members:
    """Members of whole groups (filter, block, block), sorted by group."""

    def __init__(self, batch: pa.RecordBatch, starts: np.ndarray, cfg: Caps):
        self.cfg, self.n = cfg, batch.num_rows
        self.group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, self.n)))
        self.filter = batch.column("filter").to_numpy()
        self.side = batch.column("side").to_numpy()
        self.cross = batch.column("low").to_numpy() != batch.column("high").to_numpy()
        self.vectors = _doubles(batch.column("embedding"), np.arange(self.n))
        self.square = (self.vectors * self.vectors).sum(axis=1)
        self.unit = self.vectors / np.sqrt(self.square)[:, None]
        lists = batch.column("filters").take(pa.array(np.arange(self.n)))  # without the offset of a slice
        long = _lengths(lists)
        self.filters = np.full((self.n, max(long.max(initial=0), 1)), -1, dtype=np.int64)
        self.filters[np.arange(self.filters.shape[1]) < long[:, None]] = lists.flatten().to_numpy()

    def near(self, a: np.ndarray, b: np.ndarray, cosine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the pairs those that reach the threshold."""
        limit = self.cfg.cosine
        close = np.flatnonzero(np.abs(cosine - limit) < _SLACK)
        if len(close):
            i, j = a[close], b[close]
            cosine[close] = (self.vectors[i] * self.vectors[j]).sum(axis=1) / (np.sqrt(self.square[i]) * np.sqrt(self.square[j]))
        keep = cosine >= limit
        return a[keep], b[keep]

    def first(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the pairs those that share no filter before their group's."""
        keep = np.ones(len(a), dtype=bool)
        step = max(_PAIRS // self.filters.shape[1] ** 2, 1)
        for at in range(0, len(a), step):
            i, j = a[at:at + step], b[at:at + step]
            own = self.filter[i][:, None]
            left = np.where(self.filters[i] < own, self.filters[i], -1)
            same = (left[:, :, None] == self.filters[j][:, None, :]) & (left >= 0)[:, :, None]
            keep[at:at + step] = ~same.any(axis=(1, 2))
        return a[keep], b[keep]

    def small(self, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Links within groups of at most ``longest`` members."""
        size = np.bincount(self.group)[self.group]
        for k in range(1, longest):
            i = np.flatnonzero((self.group[:-k] == self.group[k:]) & (size[:-k] <= longest)) if k < self.n else np.empty(0, dtype=np.int64)
            for at in range(0, len(i), 1 << 15):
                a = i[at:at + (1 << 15)]
                a = a[~self.cross[a] | (self.side[a] != self.side[a + k])]
                yield self.first(*self.near(a, a + k, np.einsum("ij,ij->i", self.unit[a], self.unit[a + k])))

    def large(self, start: int, stop: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Links within one group by matrix products; shared earlier filters as a product of incidence matrices."""
        rows = np.arange(start, stop)
        earlier = np.where(self.filters[rows] < self.filter[start], self.filters[rows], -1)
        known, counts = np.unique(earlier, return_counts=True)
        known = known[(counts > 1) & (known >= 0)]  # what one member alone has is not shared
        place = np.searchsorted(known, earlier)
        hit = (place < len(known)) & (earlier >= 0)
        hit[hit] = known[place[hit]] == earlier[hit]
        holds = np.zeros((len(rows), len(known)), dtype=np.float32)
        holds[np.nonzero(hit)[0], place[hit]] = 1
        step = max(_PAIRS // len(rows), 1)
        for at in range(0, len(rows), step):
            cosine = self.unit[rows[at:at + step]] @ self.unit[rows].T
            i, j = np.nonzero(cosine >= self.cfg.cosine - _SLACK)
            if len(known):
                shared = holds[at:at + step] @ holds.T
                keep = shared[i, j] == 0
                i, j = i[keep], j[keep]
            value = cosine[i, j]
            i = i + at
            keep = i < j
            if self.cross[start]:
                keep &= self.side[rows[i]] != self.side[rows[j]]
            yield self.near(rows[i[keep]], rows[j[keep]], value[keep])


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n rows the least row that links (a, b) connect it with."""
    root = np.arange(n)
    while True:
        least = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], least)
        np.minimum.at(root, root[b], least)
        np.minimum.at(root, a, least)
        np.minimum.at(root, b, least)
        root = root[root]
        if (root == before).all():
            return root


def _linked(batch: pa.RecordBatch, cfg: Caps) -> pa.RecordBatch:
    """cid, links and root of the members of whole groups that have links there."""
    starts = _starts(batch)
    members = _Members(batch, starts, cfg)
    found = list(members.small(64))
    for start, stop in zip(starts, np.append(starts[1:], members.n)):
        if stop - start > 64:
            found.extend(members.large(start, stop))
    a, b = (np.concatenate([f[s] for f in found] or [np.empty(0, dtype=np.int64)]) for s in (0, 1))
    copies, cid = batch.column("copies").to_numpy(), batch.column("cid").to_numpy()
    links = np.zeros(members.n, dtype=np.int64)
    np.add.at(links, a, copies[b])
    np.add.at(links, b, copies[a])
    root, has = _forest(members.n, a, b), np.flatnonzero(links)
    return pa.RecordBatch.from_arrays([pa.array(cid[has]), pa.array(links[has]), pa.array(cid[root[has]])], names=["cid", "links", "root"])


_KEY = ["length", "filter", "low", "high"]


def _starts(rows: pa.Table | pa.RecordBatch) -> np.ndarray:
    """Where groups begin."""
    keys = np.stack([rows.column(c).to_numpy() for c in _KEY])
    return np.flatnonzero(np.append(True, (keys[:, 1:] != keys[:, :-1]).any(axis=0)))


def _verified(cfg: Caps):
    """Over rows sorted by group; the last group of a batch waits for the next batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([*held, batch]).combine_chunks()
            last = int(_starts(rows)[-1])
            for whole in _by_length(rows.slice(0, last)):
                yield _linked(whole, cfg)
            held = rows.slice(last).combine_chunks().to_batches()
        for whole in _by_length(pa.Table.from_batches(held)) if held else []:
            yield _linked(whole, cfg)

    return run


def _by_length(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """Pieces of equally long vectors; groups hold one length only."""
    long = rows.column("length").to_numpy()
    ends = np.append(np.flatnonzero(np.diff(long)) + 1, len(long)) if len(long) else []
    at = 0
    for end in ends:
        yield rows.slice(at, end - at).combine_chunks().to_batches()[0]
        at = int(end)


def links(classes: DataFrame, cfg: Caps) -> DataFrame:
    """cid, links (rows of other classes linked directly) and root: partial rows of ``classes`` (cid, copies,
    embedding), to be added up; (cid, root) are edges that connect what links connect."""
    n = classes.count()
    told = cut(filtered(classes, cfg.sized(n), cfg))
    single = told.select("cid", "length", F.explode("filters").alias("filter"))
    # a filter that one vector alone passes goes before any vector moves
    sizes = single.groupBy("length", "filter").agg(F.count("*").alias("n")).filter("n > 1")
    sizes = sizes.select("length", "filter", F.ceil(F.col("n") / cfg.block_rows).cast("int").alias("blocks"))
    kept = single.join(sizes, ["length", "filter"]).groupBy("cid").agg(F.collect_list(F.struct("filter", "blocks")).alias("at"))
    rows = classes.join(told, "cid").join(kept, "cid").select("cid", "copies", "embedding", "length", "filters", F.explode("at").alias("at"))
    side = F.pmod(F.xxhash64("cid"), F.col("at.blocks")).cast("int")
    rows = rows.withColumn("side", side).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("at.blocks") - 1)))
    rows = rows.select("cid", "copies", "embedding", "length", "filters", F.col("at.filter").alias("filter"), "side",
                       F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high"))
    dealt = rows.repartition(compute_tasks(rows.sparkSession), *_KEY).sortWithinPartitions(*_KEY)
    return dealt.mapInArrow(_verified(cfg), "cid long, links long, root long")


def near_vectors(vectors: DataFrame, cfg: Caps = Caps()) -> DataFrame:
    """vec_id, n_links, component_id and kept for each row of ``vectors`` (vec_id, embedding; nothing else is
    read): the other rows whose cosine reaches ``cfg.cosine``, and the least vec_id that links reach.

    Vectors that are null, empty, zero or hold null or non-finite components have no links and are their own
    component; so are vectors without a partner. Vectors link with others of their length only. Rows of equal
    vectors are linked whatever their ids; repeated rows count each. A null id never is a component id: alone it
    has a null component and is not kept. An empty table gives an empty result.
    """
    x = F.col("embedding")
    good = finite(x) & F.exists(x, lambda v: v != 0)
    rows = vectors.select("vec_id", F.when(good, x).alias("embedding"))
    digest = [F.xxhash64("embedding").alias("h"), F.xxhash64(F.lit(1), "embedding").alias("g")]
    keyed = rows.select("vec_id", *(F.when(x.isNotNull(), d).alias(k) for d, k in zip(digest, "hg")))
    classes = rows.filter(x.isNotNull()).select("vec_id", "embedding", *digest).groupBy("h", "g").agg(
        F.count("*").alias("copies"), F.min("vec_id").alias("least"), F.first("embedding").alias("embedding"))
    classes = cut(classes.withColumn("cid", F.monotonically_increasing_id()))  # kept with its ids
    found = cut(links(classes, cfg))
    roots = components(found.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    counted = found.groupBy("cid").agg(F.sum("links").alias("links"))
    placed = classes.select("cid", "h", "g", "copies", "least").join(counted, "cid", "left").join(
        roots.withColumnRenamed("node", "cid"), "cid", "left")
    placed = cut(placed.select("h", "g", "copies", "least", F.coalesce("root", "cid").alias("root"),
                               (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")))
    first = placed.groupBy("root").agg(F.min("least").alias("component"))
    placed = cut(placed.join(first, "root").select("h", "g", "copies", "n_links", "component"))
    total = placed.agg(F.sum("copies")).first()[0] or 0
    hot = F.broadcast(placed.filter(F.col("copies") * _HOT > total))  # at most _HOT rows
    often = keyed.join(hot, ["h", "g"])
    seldom = keyed.join(hot.select("h", "g"), ["h", "g"], "left_anti").join(placed.filter(F.col("copies") * _HOT <= total), ["h", "g"], "left")
    out = often.unionByName(seldom).withColumn("component_id", F.when(F.col("h").isNull(), F.col("vec_id")).otherwise(F.col("component")))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id",
                      F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def op12(vectors: DataFrame) -> DataFrame:
    return near_vectors(vectors)
