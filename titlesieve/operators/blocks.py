"""Distributed block products: two tables cut into bounded blocks, every needed pair of blocks
meeting once in one Arrow cogroup. Rows of a block pair never leave it except as a partial top-k."""

from __future__ import annotations

import ctypes
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import compute_tasks


@dataclass(frozen=True)
class Chars:
    """Text columns of the two sides and how many characters of them a block may hold."""

    left: str
    right: str
    most: int

    def blocks(self, column: str) -> Column:
        return F.ceil(F.coalesce(F.sum(F.length(column)), F.lit(0)) / self.most)


def grid(
    left: DataFrame, right: DataFrame, cell: str, left_rows: int, right_rows: int, chars: Chars | None = None, waves: int = 1
) -> DataFrame:
    """(cell, blocks of the left side, blocks of the right side) for cells present on both sides.
    The left side, whose rows are searched one by one in a prepared right block, is cut finer than
    its limit, down to a fraction of it, while that feeds idle cores, ``waves`` times over. Long texts ask for more blocks."""
    cores = left.sparkSession.sparkContext.defaultParallelism
    n = F.count("*")
    fine = F.greatest(F.least(F.ceil(n / (cores * waves)), F.lit(left_rows)), F.lit(max(left_rows // 64, 1)))
    of_left, of_right = F.ceil(n / fine), F.ceil(n / right_rows)
    if chars is not None:
        of_left, of_right = F.greatest(of_left, chars.blocks(chars.left)), F.greatest(of_right, chars.blocks(chars.right))
    return (
        left.groupBy(cell).agg(of_left.cast("int").alias("_left_blocks"))
        .join(right.groupBy(cell).agg(of_right.cast("int").alias("_right_blocks")), cell)
    )


def _fine_rows(rows: int, limit: int, cores: int) -> int:
    return max(min(-(-rows // cores), limit), limit // 64, 1)


def _spread(n: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), n - 1))


def _block(key: str, n: Column) -> Column:
    return F.pmod(F.xxhash64(key), n).cast("int")


def block_product(
    left: DataFrame,
    right: DataFrame,
    cell: str,
    left_key: str,
    right_key: str,
    left_rows: int,
    right_rows: int,
    kernel: Callable,
    schema: str,
    chars: Chars | None = None,
    waves: int = 1,
) -> DataFrame:
    """Run ``kernel(left_table, right_table)`` on every pair of blocks within a cell.

    A cell's rows are hash-split by their key into as many blocks as its size asks for, so a cell
    holding a third of the table becomes many groups, none above the block size. The grid has one
    row per cell and callers bound the number of cells, which makes it safe to broadcast.
    """
    plan = F.broadcast(grid(left, right, cell, left_rows, right_rows, chars, waves))
    n_left, n_right = F.col("_left_blocks"), F.col("_right_blocks")
    cut_left = left.join(plan, cell).withColumn("_lb", _block(left_key, n_left)).withColumn("_rb", _spread(n_right))
    cut_right = right.join(plan, cell).withColumn("_rb", _block(right_key, n_right)).withColumn("_lb", _spread(n_left))
    return _meet(cut_left, cut_right, (cell, "_lb", "_rb"), kernel, schema)


def whole_product(
    left: DataFrame,
    right: DataFrame,
    left_key: str,
    right_key: str,
    left_rows: int,
    right_rows: int,
    kernel: Callable,
    schema: str,
) -> DataFrame:
    """The same without cells: every block of one table meets every block of the other."""
    cores = left.sparkSession.sparkContext.defaultParallelism
    asked = left.count()
    n_left = F.lit(max(-(-asked // _fine_rows(asked, left_rows, cores)), 1))
    n_right = F.lit(max(-(-right.count() // right_rows), 1))
    cut_left = left.withColumn("_lb", _block(left_key, n_left)).withColumn("_rb", _spread(n_right))
    cut_right = right.withColumn("_rb", _block(right_key, n_right)).withColumn("_lb", _spread(n_left))
    return _meet(cut_left, cut_right, ("_lb", "_rb"), kernel, schema)


def _meet(left: DataFrame, right: DataFrame, keys: tuple[str, ...], kernel: Callable, schema: str) -> DataFrame:
    # the exchange the cogroup needs anyway, but with a fixed number of tasks: the work of a block
    # pair grows with the product of its sides, so merging partitions by their bytes would serialise it. Pairs are dealt
    # by hash: more tasks than elsewhere, so that few cores wait for one that got many
    tasks = max(compute_tasks(left.sparkSession), 12 * left.sparkSession.sparkContext.defaultParallelism)
    left = left.drop("_left_blocks", "_right_blocks").repartition(tasks, *keys)
    right = right.drop("_left_blocks", "_right_blocks").repartition(tasks, *keys)
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_giving_back(kernel), schema)


def _giving_back(kernel: Callable) -> Callable:
    """``kernel``, after which memory that the allocators keep of freed arrays goes back to the system. Spark keeps
    idle workers and deals later tasks out to any of them, so that each would come to hold what its largest block took."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = kernel(left, right)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
        if trim is not None:
            trim(0)
        return out

    return run
