"""Near-duplicate documents: banded MinHash proposes, odd sketches screen, full shingle sets decide.

Equal sets are one class from the start, so copies cost nothing further. A class joins the bucket of each
of its bands. First every bucket compares its members with a few random leaders only; what the full sets
confirm is merged into components, and this is repeated with other leaders if it removes much of the pairs
still open. Then, in buckets whose members still lie in several components, all remaining pairs across
components are screened inside the bucket's task, also by size and by the parity of the whole sets, which tells the
number of differing shingles almost exactly; only pairs that pass become rows. A group of thousands of near copies thus hardly meets pair by pair, and no candidate
between different components is dropped, however large its bucket.

The odd sketch of a class holds, bit by bit, the parity of how many of its MinHash samples fall on the bit.
The population count of the XOR of two sketches estimates how many samples differ, which is precise at high
similarities; a pair goes on if its count lies within ``spare`` standard deviations of what the wanted
similarity gives. The bands miss a pair at the very threshold with a probability of 3 in a million and the
screen with one of about as much; more similar pairs are safer by far.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import bloom
from ..session import compute_tasks
from .common import cut
from .components import components
from .shingles import mix, shingle_sets, sliced

_CHUNK = 2048  # shingles whose samples are held at once
_SEED = 7
_SIEVE_BITS, _MOST_SIEVE_BITS = 16, 1 << 26  # of the Bloom filter by doc_id: a key, in all


@dataclass(frozen=True)
class NearDup:
    words: int = 5  # of a shingle
    percent: int = 80  # of the union that the intersection must reach
    bands: int = 42
    rows: int = 6  # samples a band
    samples: int = 504  # of the odd sketch; the first bands * rows of them also make the bands
    bits: int = 2048  # of an odd sketch
    spare: float = 4.5  # standard deviations that the sketch screen leaves
    leaders: int = 4  # of each bucket in a round
    meets: int = 16  # leaders of its buckets that a member is compared with in a round
    turns: int = 2  # rounds at most; what they leave open is compared across components
    whole: int = 4096  # shingles up to which all go into the parity of the set; of larger sets a half, a quarter, ...
    block_rows: int = 2048  # members of a bucket's block in the comparison across components

    @property
    def most_bits(self) -> int:
        """Differing sketch bits up to which a pair may have the wanted similarity: mean and standard deviation
        of a binomial number of differing samples, each of which flips two random bits."""
        share = 1 - self.percent / 100
        differ = self.samples * share
        return int(self._bits(2 * differ, 4 * differ * (1 - share)))

    def _bits(self, flips, spread):
        """Bits that ``flips`` random flips of variance ``spread`` change, with ``spare`` deviations and one bit more."""
        n = self.bits
        mean = n / 2 * (1 - (1 - 2 / n) ** flips)
        parity = n / 4 + n * (n - 1) / 4 * (1 - 4 / n) ** flips - n * n / 4 * (1 - 2 / n) ** (2 * flips)
        slope = (1 - 2 / n) ** flips
        return mean + self.spare * np.sqrt(np.maximum(parity, 0) + slope**2 * spread) + 1

    def level(self, size: np.ndarray) -> np.ndarray:
        """How often a set is halved by hash before its parity is taken."""
        return np.ceil(np.log2(np.maximum(size, 1) / self.whole)).clip(0).astype(np.int64)

    def set_bits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Differing parity bits up to which sets of ``a`` and ``b`` shingles may have the wanted similarity. So
        similar sets differ in a bounded number of shingles, of which each level keeps about a half."""
        differ = np.floor((a + b) * (100 - self.percent) / (100 + self.percent))
        share = 0.5 ** np.maximum(self.level(a), self.level(b))
        return self._bits(differ * share, differ * share * (1 - share))


def _signer(cfg: NearDup):
    """From a shingle set to its band hashes and its odd sketch."""
    k = cfg.samples
    seeds = mix(np.arange(1, 2 * k + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(_SEED))
    times, plus = (seeds[:k] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), seeds[k:].astype(np.uint32)
    place, band = np.arange(k, dtype=np.uint64) << np.uint64(32), np.arange(cfg.bands, dtype=np.uint64)[:, None]

    def sign(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low, best = mix(found).astype(np.uint32), np.full(k, 0xFFFFFFFF, dtype=np.uint32)
        for at in range(0, len(low), _CHUNK):
            best = np.minimum(best, (times[:, None] * low[None, at:at + _CHUNK] + plus[:, None]).min(axis=1))
        samples = mix(place | best)
        bands = np.zeros(cfg.bands, dtype=np.uint64)
        for column in samples[: cfg.bands * cfg.rows].reshape(cfg.bands, cfg.rows).T:
            bands = mix(bands + column)
        return mix(bands + band[:, 0]).view(np.int64), _odd(samples, cfg)

    return sign


def _odd(hashes: np.ndarray, cfg: NearDup) -> np.ndarray:
    """The parity, place by place, of how many hashes fall there."""
    odd = np.bincount((hashes % np.uint64(cfg.bits)).astype(np.int64), minlength=cfg.bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _parity(found: np.ndarray, cfg: NearDup) -> np.ndarray:
    """Odd sketch of the whole set at its level and, where a partner may lie a level above, at the next."""
    hashes, level = mix(found ^ np.uint64(0xA5A5A5A5A5A5A5A5)), int(cfg.level(np.array([len(found)]))[0])
    above = level + 1 if cfg.level(np.array([len(found) * 100 / cfg.percent + 1]))[0] > level else level
    kept = lambda k: hashes[(hashes >> np.uint64(40)) & np.uint64((1 << k) - 1) == 0]
    return np.concatenate([_odd(kept(k), cfg) for k in range(level, above + 1)])


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows], dtype=np.int64)]).astype(np.int32)
    flat = np.concatenate(rows) if rows else np.empty(0, dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int64()))


def signatures(docs: DataFrame, cfg: NearDup) -> DataFrame:
    """doc_id, mark (digest of the text), n_shingles, key (digest of the set, null for an empty one), bands, sketch."""

    def run(batches):
        sign, none = _signer(cfg), np.empty(0, dtype=np.int64)
        for batch in sliced(batches, "text"):
            n, keys, told = [], [], ([], [])
            for found in shingle_sets(batch.column("text"), cfg.words):
                n.append(len(found))
                keys.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
                for list_, part in zip(told, sign(found) if len(found) else (none, none)):
                    list_.append(part)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("mark"), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), *map(_lists, told)],
                names=["doc_id", "mark", "n_shingles", "key", "bands", "sketch"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", _mark().alias("mark")).mapInArrow(
        run, f"doc_id {kind}, mark string, n_shingles long, key binary, bands array<long>, sketch array<long>")


def _mark() -> Column:
    return F.md5(F.col("text").cast("binary"))


def keyed_sets(docs: DataFrame, cfg: NearDup) -> DataFrame:
    """key, the whole shingle set and its parity, of each document that has one."""

    def run(batches):
        for batch in sliced(batches, "text"):
            found = [f for f in shingle_sets(batch.column("text"), cfg.words) if len(f)]
            keys = [hashlib.blake2b(f.tobytes(), digest_size=16).digest() for f in found]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), _lists([f.view(np.int64) for f in found]), _lists([_parity(f, cfg) for f in found])],
                                             names=["key", "shingles", "parity"])

    return docs.select("text").mapInArrow(run, "key binary, shingles array<long>, parity array<long>")


def _close(a: Column, b: Column, cfg: NearDup) -> Column:
    """The sketches allow the wanted similarity."""
    differ = F.bit_count(a[0].bitwiseXOR(b[0]))
    for i in range(1, cfg.bits // 64):
        differ = differ + F.bit_count(a[i].bitwiseXOR(b[i]))
    return differ <= cfg.most_bits


def _confirmed(pairs: DataFrame, sets: DataFrame, cfg: NearDup) -> DataFrame:
    """Of the pairs (a, b) those whose full sets are similar enough."""
    side = lambda c: sets.select(F.col("cid").alias(c), F.col("shingles").alias(f"s{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    both = both.select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), F.size(F.array_intersect("sa", "sb")).alias("n"))
    return both.filter(100 * F.col("n") >= cfg.percent * (F.col("na") + F.col("nb") - F.col("n"))).select("a", "b")


def _linked(docs: DataFrame, classes: DataFrame, cfg: NearDup) -> DataFrame:
    """(node, root) of the classes that similar sets link."""
    banded = classes.select(F.explode("bands").alias("band"), "cid")
    leaders = banded.groupBy("band").agg(F.count("*").alias("n"), F.min("cid").alias("leader")).filter("n > 1")
    members = cut(banded.join(leaders.select("band", "leader"), "band"))
    # whatever shares no bucket is done with; only what does moves on with its text
    involved = members.select("cid").distinct().join(classes, "cid").select("cid", "key", "rep", "n_shingles", "bands", "sketch")
    involved = cut(involved)
    sieve = bloom.build(involved, "rep", involved.count(), _SIEVE_BITS, _MOST_SIEVE_BITS)
    texts = docs.select("doc_id", "text")
    if sieve is not None:
        texts = texts.filter(F.col("doc_id").isNull() | sieve.may_hold(F.col("doc_id")))
    texts = texts.join(involved.select("rep"), F.expr("doc_id <=> rep"), "left_semi")
    found = keyed_sets(texts, cfg).groupBy("key").agg(F.first("shingles").alias("shingles"), F.first("parity").alias("parity"))
    sets = cut(found.join(involved.select("key", "cid", "n_shingles", "bands", "sketch"), "key").drop("key"))
    sketch = lambda c: sets.select(F.col("cid").alias(c), F.col("sketch").alias(f"o{c}"))

    roots, tested, open_before, turn = None, None, None, 0
    while True:
        rooted = members if roots is None else members.join(roots.withColumnRenamed("node", "cid"), "cid", "left")
        rooted = rooted.select("band", "cid", (F.col("cid") if roots is None else F.coalesce("root", "cid")).alias("root"))
        by_root = rooted.groupBy("band", "root").agg(F.count("*").alias("n")).groupBy("band").agg(
            F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("within"), F.count("*").alias("roots")).filter("roots > 1")
        rooted = cut(rooted.join(by_root.select("band", "n", "within"), "band"))
        # what a comparison of all members across components would still take
        row = rooted.agg(F.count("*").alias("rows"), F.sum((F.col("n") * F.col("n") - F.col("within")) / (2 * F.col("n"))).alias("pairs")).first()
        if not row["rows"]:
            return roots if roots is not None else rooted.select(F.col("cid").alias("node"), "root")
        if turn == cfg.turns or row["pairs"] <= cfg.leaders * row["rows"] and turn or open_before is not None and row["pairs"] > 0.7 * open_before:
            break
        open_before, turn = row["pairs"], turn + 1
        first = Window.partitionBy("band").orderBy(F.xxhash64("cid", F.lit(turn)))
        lead = rooted.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= cfg.leaders)
        lead = lead.select("band", F.col("cid").alias("leader"), F.col("root").alias("over"))
        pairs = rooted.join(lead, "band").filter("root <> over")
        # over all its buckets a member meets a bounded number of leaders, so a round is linear in the members
        few = Window.partitionBy("cid").orderBy(F.xxhash64("leader", F.lit(turn)))
        pairs = pairs.select("cid", "leader").distinct().withColumn("place", F.row_number().over(few)).filter(F.col("place") <= cfg.meets)
        pairs = pairs.select(F.least("cid", "leader").alias("a"), F.greatest("cid", "leader").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = pairs.join(sketch("a"), "a").join(sketch("b"), "b").filter(_close(F.col("oa"), F.col("ob"), cfg)).select("a", "b")
        pairs = cut(pairs)
        tested = pairs if tested is None else tested.unionByName(pairs)
        roots = _merged(roots, cut(_confirmed(pairs, sets, cfg)))
    across = cut(_across(rooted, sets, cfg).join(tested, ["a", "b"], "left_anti"))
    return _merged(roots, _confirmed(across, sets, cfg))


_KEY = ["band", "low", "high"]


def _across(rooted: DataFrame, sets: DataFrame, cfg: NearDup) -> DataFrame:
    """Pairs (a, b) of different components that share a band and may have the wanted similarity by their sizes,
    their odd sketches and the parities of their whole sets. Buckets are compared inside tasks, large ones block by
    block; a pair is judged in the first band its members share, and only what passes becomes a row."""
    blocks = F.ceil(F.col("n") / cfg.block_rows).cast("int")
    at = rooted.groupBy("cid", "root").agg(F.collect_list(F.struct("band", blocks.alias("blocks"))).alias("at"))
    rows = at.join(sets.drop("shingles"), "cid").withColumn("at", F.explode("at"))
    rows = rows.withColumn("side", F.pmod(F.xxhash64("cid"), F.col("at.blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("at.blocks") - 1)))
    rows = rows.select("cid", "root", "n_shingles", "bands", "sketch", "parity", "side", F.col("at.band").alias("band"),
                       F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high"))
    rows = rows.repartition(compute_tasks(rows.sparkSession), *_KEY).sortWithinPartitions(*_KEY)

    def run(batches):
        held = []
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([*held, batch]).combine_chunks()
            last = int(_starts(table)[-1])  # the last group may go on in the next batch
            if last:
                yield _open_pairs(table.slice(0, last), cfg)
            held = table.slice(last).combine_chunks().to_batches()
        if held:
            yield _open_pairs(pa.Table.from_batches(held), cfg)

    return rows.mapInArrow(run, "a long, b long")


def _starts(table: pa.Table) -> np.ndarray:
    keys = np.stack([table.column(c).to_numpy() for c in _KEY])
    return np.flatnonzero(np.append(True, (keys[:, 1:] != keys[:, :-1]).any(axis=0)))


def _rows_of(column: pa.ChunkedArray) -> np.ndarray:
    """Equally long lists as a matrix."""
    return np.concatenate([c.flatten().to_numpy(zero_copy_only=False).reshape(len(c), -1) for c in column.chunks])


class _Members:
    """Members of whole groups (band, block, block)."""

    def __init__(self, table: pa.Table, cfg: NearDup):
        self.cfg, self.wide = cfg, cfg.bits // 64
        self.cid, self.root, self.size, self.side, band = (table.column(c).to_numpy() for c in ("cid", "root", "n_shingles", "side", "band"))
        self.cross = table.column("low").to_numpy() != table.column("high").to_numpy()
        self.bands, self.sketch, self.level = _rows_of(table.column("bands")), _rows_of(table.column("sketch")), cfg.level(self.size)
        self.place = (self.bands == band[:, None]).argmax(axis=1)  # a band has one place in all lists
        self.parity = np.empty((len(self.cid), 2 * self.wide), dtype=np.int64)
        for i, p in enumerate(p for c in table.column("parity").chunks for p in c):
            p = p.values.to_numpy()
            self.parity[i, :self.wide], self.parity[i, self.wide:] = p[:self.wide], p[-self.wide:]

    def open_(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the pairs of rows those that remain open here."""
        cfg = self.cfg
        i, j = np.where(self.size[i] <= self.size[j], i, j), np.where(self.size[i] <= self.size[j], j, i)
        keep = (self.root[i] != self.root[j]) & (~self.cross[i] | (self.side[i] != self.side[j]))
        keep &= 100 * self.size[i] >= cfg.percent * self.size[j]
        i, j = i[keep], j[keep]
        count = lambda x: np.bitwise_count(x.view(np.uint64)).sum(axis=1, dtype=np.int64)  # noqa: E731  of signed numbers it takes the absolute value
        keep = count(self.sketch[i] ^ self.sketch[j]) <= cfg.most_bits
        i, j = i[keep], j[keep]
        above = (self.level[j] > self.level[i])[:, None]
        lower = np.where(above, self.parity[i, self.wide:], self.parity[i, :self.wide])
        keep = count(lower ^ self.parity[j, :self.wide]) <= cfg.set_bits(self.size[i], self.size[j])
        i, j = i[keep], j[keep]
        before = np.arange(self.bands.shape[1])[None, :] < self.place[i][:, None]
        keep = ~((self.bands[i] == self.bands[j]) & before).any(axis=1)
        return i[keep], j[keep]


_SMALL = 32  # members up to which groups are compared together, by distance in the table


def _open_pairs(table: pa.Table, cfg: NearDup) -> pa.RecordBatch:
    """What :func:`_across` gives out of whole groups."""
    starts = _starts(table)
    sizes = np.diff(np.append(starts, len(table)))
    members, group, of = _Members(table, cfg), np.repeat(np.arange(len(starts)), sizes), np.repeat(sizes, sizes)
    found = []
    for k in range(1, min(_SMALL, int(sizes.max()))):
        i = np.flatnonzero((group[:-k] == group[k:]) & (of[:-k] <= _SMALL))
        found.append(members.open_(i, i + k))
    for start, size in zip(starts[sizes > _SMALL], sizes[sizes > _SMALL]):
        for i in range(start, start + size - 1):
            j = np.arange(i + 1, start + size)
            found.append(members.open_(np.full(len(j), i), j))
    i, j = (np.concatenate([f[c] for f in found] or [np.empty(0, dtype=np.int64)]) for c in (0, 1))
    a, b = members.cid[i], members.cid[j]
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def _merged(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """(node, root) after ``links`` (a, b) join components."""
    if roots is None:
        return cut(components(links))
    end = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
    joins = links.join(end("a"), "a", "left").join(end("b"), "b", "left")
    joins = joins.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    over = components(joins).select(F.col("root").alias("over"), F.col("node").alias("root"))
    return cut(roots.join(over, "root", "full").select(F.coalesce("node", "root").alias("node"), F.coalesce("over", "root").alias("root")))


def classes_of(docs: DataFrame, cfg: NearDup) -> tuple[DataFrame, DataFrame]:
    """Documents as (doc_id, n_shingles, key) and classes as (key, rep, mark, component_id, root); ``rep`` and ``mark``
    name the class's document of smallest doc_id and its text."""
    signed = cut(signatures(docs, cfg))
    grouped = signed.filter("n_shingles > 0").groupBy("key").agg(
        F.min("doc_id").alias("rep"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "mark"))["mark"].alias("mark"),
        *(F.first(c).alias(c) for c in ("n_shingles", "bands", "sketch")))
    classes = cut(grouped.withColumn("cid", F.monotonically_increasing_id()))  # kept with its ids
    roots = _linked(docs, classes, cfg)
    placed = classes.select("cid", "key", "rep", "mark").join(roots.withColumnRenamed("node", "cid"), "cid", "left")
    placed = cut(placed.select("key", "rep", "mark", F.coalesce("root", "cid").alias("root")))
    least = placed.groupBy("root").agg(F.min("rep").alias("component_id"))
    return signed.select("doc_id", "n_shingles", "key"), cut(placed.join(least, "root"))


def near_duplicates(docs: DataFrame, cfg: NearDup = NearDup()) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text; nothing else is read): doc_id, n_shingles,
    component_id (smallest doc_id reachable over similar documents) and kept (doc_id = component_id).

    A null, empty or wordless text has an empty set, links with nothing and is its own component. Rows with
    equal texts are linked, whatever their ids; repeated rows repeat. A null doc_id never is a component id:
    alone it has a null component and is not kept. An empty table gives an empty result.
    """
    signed, placed = classes_of(docs, cfg)
    joined = signed.join(placed.select("key", "component_id"), "key", "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"),
                         F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def deduplicated(docs: DataFrame, cfg: NearDup = NearDup()) -> DataFrame:
    """``docs`` with one row of each component: of the class of its smallest doc_id, that document, once. Documents
    without words stay. Columns beginning with ``_nd_`` are reserved."""
    signed, placed = classes_of(docs, cfg)
    chosen = placed.filter(F.col("rep").eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.min(F.struct("key", "rep", "mark")).alias("c"))
    chosen = chosen.select(F.col("c.rep").alias("_nd_rep"), _row_key(F.col("c.rep"), F.col("c.mark")).alias("_nd_key"))
    # a document whose id no other row has stays where it is if it was chosen; only the others meet the choice
    ids = signed.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("n_shingles").alias("size"))
    ids = ids.join(chosen.select(F.col("_nd_rep").alias("doc_id")), "doc_id", "left_anti").filter("size > 0").select("doc_id").unionByName(
        ids.filter("n > 1").select("doc_id"))
    ids = cut(ids)
    sieve = bloom.build(ids, "doc_id", ids.count(), _SIEVE_BITS, _MOST_SIEVE_BITS)
    worded = F.coalesce(F.col("text"), F.lit("")).rlike(_IN_WORD)
    moves = worded if sieve is None else worded & (F.col("doc_id").isNull() | sieve.may_hold(F.col("doc_id")))
    # the key of the choice is that of the copies too: their texts are shuffled once
    copies = docs.filter(moves).withColumn("_nd_key", _row_key(F.col("doc_id"), _mark())).join(chosen.select("_nd_key"), "_nd_key", "left_semi")
    return docs.filter(~moves).unionByName(copies.dropDuplicates(["_nd_key"]).select(*docs.columns))


_IN_WORD = r"[^\x20\x09-\x0D]"


def _row_key(doc_id: Column, mark: Column) -> Column:
    """One value for an id, null included, and a text."""
    return F.concat_ws("/", mark, doc_id.cast("string"))
