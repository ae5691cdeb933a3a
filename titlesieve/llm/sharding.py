"""Shards of nearly equal bytes by a k-d tree over document metadata.

A node that stands for k shards is cut at the weighted quantile floor(k / 2) / k along its widest dimension,
until every leaf is one shard. Quantiles are exact down to rows alike in 48 bits: three histograms of at
most 65,536 bins a node narrow each one down, so a level costs a few passes over narrow rows and no sort.
Only DataFrame functions are used.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, log2

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, seeded_rank

_DIMENSIONS = ("by_id", "by_size", "by_source", "by_lang")
_TOP = (1 << 31) - 1
_TIE_BITS = 17


@dataclass(frozen=True)
class Sharding:
    shards: int = 40
    overhead: int = 16  # bytes that a document takes besides its text
    together: float = 1 / 64  # equal texts stay together if they take at most this part of a shard
    seed: int = 5


def shards_for(docs: DataFrame, target_bytes: int, overhead: int = 16) -> int:
    """How many shards leaves of about ``target_bytes`` make."""
    total = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + overhead)).first()[0] or 0
    return max(1, ceil(total / target_bytes))


def _items(docs: DataFrame, cfg: Sharding) -> DataFrame:
    """A narrow row a document: weight, dimensions scaled to 31 bits and a tie breaker. Rows of a small
    group of equal texts share all of these and so its shard."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + cfg.overhead
    code = lambda c: F.shiftright(F.crc32(F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary")), 1)
    rows = docs.select(
        "doc_id", size.alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(F.lit(cfg.seed), "text").alias("words"), code("source").alias("by_source"), code("lang").alias("by_lang"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("number"),
    ).withColumn("row", F.monotonically_increasing_id())
    rows = cut(rows)
    whole = rows.agg(F.sum("size").alias("total"), F.min("number").alias("low"), F.max("number").alias("high"), F.max("size").alias("largest")).first()
    low, span, largest = whole["low"] or 0, max((whole["high"] or 0) - (whole["low"] or 0), 1), whole["largest"] or 1
    most = int((whole["total"] or 0) / cfg.shards * cfg.together)
    groups = rows.groupBy("words").agg(
        F.sum("size").alias("bytes"), F.count("*").alias("n"), *[F.min(c).alias(f"g_{c}") for c in ("number", "by_source", "by_lang")],
        F.max("number").alias("g_last")).filter("n > 1")
    rows = rows.join(groups, "words", "left")
    small = F.coalesce(F.col("bytes") <= most, F.lit(False))
    alone = F.coalesce((F.col("bytes") > most) & (F.col("g_number") == F.col("g_last")), F.lit(False))  # one row many times
    pick = lambda c: F.when(small, F.col(f"g_{c}")).otherwise(F.col(c))
    tie = F.when(small, F.xxhash64("words")).when(alone, F.xxhash64("words", "row")).otherwise(F.xxhash64("words", "number"))
    scaled = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)) * _TOP
    return rows.select(
        "doc_id", "size", "text_crc32", "row",
        scaled((pick("number").cast("double") - low) / span).cast("long").alias("by_id"),
        scaled(F.col("size").cast("double") / largest).cast("long").alias("by_size"),
        pick("by_source").cast("long").alias("by_source"), pick("by_lang").cast("long").alias("by_lang"),
        F.shiftrightunsigned(tie, 64 - _TIE_BITS).alias("tie"),
    )


def _quantile(keyed: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, edge, share): rows below ``edge`` and, if ``share``, at it make the wanted weight of a node
    best. ``keyed`` has node, key (48 bits) and size, ``wanted`` node and ``left``, the weight to its left."""
    found = wanted.withColumn("edge", F.lit(0).cast("long"))
    for shift in (32, 16, 0):
        part = F.broadcast(found.select("node", "left", "edge"))  # one row a node, at most one a shard
        rows = keyed.join(part, "node")
        if shift < 32:
            rows = rows.filter(F.shiftright("key", shift + 16) == F.col("edge"))
        bins = rows.groupBy("node", "left", F.shiftright("key", shift).alias("bin")).agg(F.sum("size").alias("weight"))
        run = Window.partitionBy("node").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        bins = bins.withColumn("upto", F.sum("weight").over(run))
        reach = bins.filter((F.col("upto") >= F.col("left"))).groupBy("node").agg(F.min(F.struct("bin", "left", "weight", "upto")).alias("b"))
        found = cut(reach.select(
            "node", F.col("b.bin").alias("edge"), (F.col("b.left") - F.col("b.upto") + F.col("b.weight")).alias("left"),
            F.col("b.weight").alias("weight")).coalesce(1))
    return found.select("node", "edge", (2 * F.col("left") > F.col("weight")).alias("share"))


def assign(docs: DataFrame, cfg: Sharding = Sharding()) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text, source, lang; nothing else is read): doc_id, size,
    text_crc32, shard (0 to ``shards`` - 1) and slot (gapless from 0 in each shard).

    Nulls in source and lang count as empty, a null or empty text has the overhead as its size, a null
    doc_id lies at 0. Equal texts share a shard while all of them take at most ``together`` of one; larger
    groups are split like other rows. Repeated rows are rows of their own. With fewer documents than shards
    some shards stay empty; an empty table gives an empty result.
    """
    rows = _items(docs, cfg).withColumn("node", F.lit(0)).withColumn("k", F.lit(cfg.shards))
    rows = cut(rows)
    for _ in range(ceil(log2(cfg.shards)) if cfg.shards > 1 else 0):
        wide = rows.filter("k > 1").groupBy("node", "k").agg(
            F.sum("size").alias("all"), *[(F.max(d) - F.min(d)).alias(d) for d in _DIMENSIONS])
        most = F.greatest(*_DIMENSIONS)
        choice = F.coalesce(*[F.when(F.col(d) == most, F.lit(d)) for d in _DIMENSIONS])
        nodes = cut(wide.select("node", choice.alias("widest"), (F.col("all") * F.floor(F.col("k") / 2) / F.col("k")).alias("left")).coalesce(1))
        value = F.coalesce(*[F.when(F.col("widest") == d, F.col(d)) for d in _DIMENSIONS])
        keyed = rows.join(F.broadcast(nodes.select("node", "widest")), "node").withColumn("key", F.shiftleft(value, _TIE_BITS).bitwiseOR(F.col("tie")))
        edges = _quantile(keyed.select("node", "key", "size"), nodes.select("node", "left"))
        split = rows.join(F.broadcast(nodes.select("node", "widest").join(edges, "node")), "node", "left")
        key = F.shiftleft(value, _TIE_BITS).bitwiseOR(F.col("tie"))
        half = F.floor(F.col("k") / 2).cast("int")
        right = (key > F.col("edge")) | ((key == F.col("edge")) & ~F.col("share"))
        rows = cut(split.select(
            "doc_id", "size", "text_crc32", "row", *_DIMENSIONS, "tie",
            F.when(F.coalesce(right, F.lit(False)), F.col("node") + half).otherwise(F.col("node")).alias("node"),
            F.when(F.col("edge").isNull(), F.col("k")).when(right, F.col("k") - half).otherwise(half).alias("k")))
    rows = rows.select("doc_id", "size", "text_crc32", "row", F.col("node").cast("int").alias("shard"))
    order = [F.xxhash64(F.lit(cfg.seed), F.col("doc_id"), F.col("text_crc32")), F.col("doc_id"), F.col("text_crc32"), F.col("row")]
    return seeded_rank(rows, ["shard"], order, "slot").drop("row")


def op10(docs: DataFrame) -> DataFrame:
    """The contract of the query: law ``bytes``."""
    return assign(docs).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
