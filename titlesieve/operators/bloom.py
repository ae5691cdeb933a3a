"""Bloom filters from public bitmap functions: a batch's keys thin a large table before it is shuffled."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BUCKET_BITS = 32_768  # bits of one bitmap aggregate
_HASHES = 4
_PIECE = 256  # bytes that a row looks at for one of its places


@dataclass(frozen=True)
class Bloom:
    """Bits that each key set at a few places. No key is missed; of other values one in some four hundred passes
    at 16 bits a key."""

    data: bytes

    @property
    def bits(self) -> int:
        return 8 * len(self.data)

    def may_hold(self, value: Column) -> Column:
        """False where the value certainly is no key; nulls are none."""
        found = F.lit(True)
        for place in _places(value, self.bits):
            found = found & _bit(_byte(F.lit(bytearray(self.data)), place), place)
        return value.isNotNull() & found

    def thinned(self, rows: DataFrame, column: str) -> DataFrame:
        """The rows whose ``column`` :meth:`may_hold` a key. The bits come in pieces by broadcast joins and are no part of
        the plan: the driver keeps a plan's text, with all literals in it, once for every step of its execution."""
        pieces = F.broadcast(rows.sparkSession.createDataFrame(
            [(i, bytearray(self.data[at:at + _PIECE])) for i, at in enumerate(range(0, len(self.data), _PIECE))],
            "_piece long, _bits binary"))
        kept = rows.filter(F.col(column).isNotNull())
        for place in _places(F.col(column), self.bits):
            inside = F.pmod(place, F.lit(8 * _PIECE))
            found = kept.withColumn("_piece", F.shiftright(place, (8 * _PIECE).bit_length() - 1)).join(pieces, "_piece")
            kept = found.filter(_bit(_byte(F.col("_bits"), inside), inside)).drop("_piece", "_bits")
        return kept


def _byte(data: Column, place: Column) -> Column:
    return F.conv(F.hex(F.substring(data, F.shiftright(place, 3).cast("int") + 1, 1)), 16, 10).cast("int")


def _bit(byte: Column, place: Column) -> Column:
    mask = F.element_at(F.array(*[F.lit(1 << i) for i in range(8)]), F.pmod(place, F.lit(8)).cast("int") + 1)
    return byte.bitwiseAND(mask) != 0


def _places(value: Column, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(seed), value), F.lit(bits)) for seed in range(_HASHES)]


def build(keys: DataFrame, column: str, rows: int, bits_per_key: int, most_bits: int) -> Bloom | None:
    """The filter of ``rows`` keys at most, or None where it would take more than ``most_bits`` bits. The driver
    holds the bits, never the keys."""
    bits = _BUCKET_BITS
    while bits < bits_per_key * rows:
        bits *= 2
    if bits > most_bits:
        return None
    places = keys.filter(F.col(column).isNotNull()).select(F.explode(F.array(*_places(F.col(column), bits))).alias("place"))
    maps = places.groupBy(F.bitmap_bucket_number(F.col("place") + 1).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(F.col("place") + 1)).alias("map"))
    data = bytearray(bits // 8)
    for r in maps.collect():  # one row a bucket
        at = (r["bucket"] - 1) * _BUCKET_BITS // 8
        data[at:at + len(r["map"])] = r["map"]
    return Bloom(bytes(data))
