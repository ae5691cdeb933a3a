"""Exact pass: proposals against usable corpus rows with the same normal form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import USABLE_STATUSES, ScreeningConfig
from ..session import cut_lineage
from . import bloom


def usable(corpus: DataFrame) -> DataFrame:
    return corpus.filter(F.col("record_status").isin(*USABLE_STATUSES))


def exact_pairs(
    proposals: DataFrame, corpus: DataFrame, cfg: ScreeningConfig = ScreeningConfig(),
    of_proposal: tuple[str, ...] = (), of_record: tuple[str, ...] = (),
) -> DataFrame:
    """Every (proposal_id, id) with equal normal forms, the empty one included; a null form equals none.
    The listing itself; screening uses :func:`exact_heads`, which never spells the pairs out. Further columns of
    either side come along if named.

    A form that more than ``hot_form_rows`` rows of a side carry is dealt over a grid: its rows go to one line or
    column of it by the hash of their id and are copied along that line, so each pair meets in exactly one cell
    and no task has more than a cell's pairs of it, about the square of ``hot_form_rows``."""
    left = proposals.select("proposal_id", "normalized_title", *of_proposal).filter(F.col("normalized_title").isNotNull())
    right = usable(corpus).select("id", "normalized_title", *of_record).filter(F.col("normalized_title").isNotNull())
    listed = ["normalized_title", "proposal_id", "id", *of_proposal, *of_record]
    grid = cut_lineage(hot_forms(left, right, cfg.hot_form_rows))
    hot = grid.limit(cfg.most_broadcast_forms + 1).count()
    if hot == 0:
        return left.join(right, "normalized_title").select(*listed)
    if hot <= cfg.most_broadcast_forms:  # three numbers a row
        grid = F.broadcast(grid)

    def dealt(rows: DataFrame, key: str, own: str, other: str, carried: tuple[str, ...]) -> DataFrame:
        found = rows.withColumn("_form", _form()).join(grid, "_form", "left").fillna(1, ["_lines", "_columns"])
        return found.select(
            key, "normalized_title", *carried, F.pmod(F.xxhash64(key), F.col(own)).alias(own + "_at"),
            F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)).alias(other + "_at"),
        )

    at = ["normalized_title", "_lines_at", "_columns_at"]
    lines = dealt(left, "proposal_id", "_lines", "_columns", of_proposal)
    return lines.join(dealt(right, "id", "_columns", "_lines", of_record), at).select(*listed)


def _form() -> Column:
    return F.xxhash64("normalized_title")


def hot_forms(left: DataFrame, right: DataFrame, rows: int) -> DataFrame:
    """(_form, _lines, _columns): the grid of every normal form, named by its hash, that both sides have and one
    of them more than ``rows`` times. Forms of equal hash share a grid, which only cuts them finer."""
    def counted(side: DataFrame, name: str) -> DataFrame:
        return side.groupBy(_form().alias("_form")).agg(F.ceil(F.count("*") / rows).alias(name))

    both = counted(left, "_lines").join(counted(right, "_columns"), "_form")
    return both.filter((F.col("_lines") > 1) | (F.col("_columns") > 1))


def title_heads(corpus: DataFrame, rows: int) -> DataFrame:
    """Per normal form: how many usable rows carry it and its ``rows`` lowest ids.

    Both parts reduce on the map side (partial count, window-group limit), so a normal form that
    holds a third of the corpus sends only a few rows per task through the shuffle.
    """
    keys = usable(corpus).select("normalized_title", "id")
    counts = keys.groupBy("normalized_title").agg(F.count("*").alias("exact_total"))
    by_id = Window.partitionBy("normalized_title").orderBy("id")
    heads = (
        keys.withColumn("_place", F.row_number().over(by_id))
        .filter(F.col("_place") <= rows)
        .groupBy("normalized_title")
        .agg(F.array_sort(F.collect_list("id")).alias("exact_ids"))
    )
    return counts.join(heads, "normalized_title")


def exact_heads(proposals: DataFrame, corpus: DataFrame, rows: int) -> DataFrame:
    """(proposal_id, exact_total, exact_ids): one bounded row per proposal with an exact hit."""
    return (
        proposals.select("proposal_id", "normalized_title")
        .join(title_heads(corpus, rows), "normalized_title")
        .drop("normalized_title")
    )


# ---------------------------------------------------------------- from stored partial rows

def head_bucket(normal: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(normal), F.lit(buckets)).cast("int")


def partial_heads(corpus: DataFrame, rows: int, buckets: int) -> DataFrame:
    """What :func:`title_heads` says of some of the corpus, with the bucket of the normal form."""
    return title_heads(corpus, rows).withColumn("bucket", head_bucket(F.col("normalized_title"), buckets))


def stored_heads(proposals: DataFrame, heads: DataFrame, rows: int, cfg: ScreeningConfig) -> DataFrame:
    """:func:`exact_heads` from partial rows. Of the stored table only the buckets of the asked forms are opened,
    and only rows that pass a Bloom filter of these forms are shuffled, merged and joined."""
    asked = proposals.select("proposal_id", "normalized_title")
    bucket = head_bucket(F.col("normalized_title"), cfg.head_buckets)
    told = asked.agg(F.count_distinct("normalized_title").alias("n"), F.collect_set(bucket).alias("buckets")).first()
    kept = heads.filter(F.col("bucket").isin(told["buckets"]))  # at most ``head_buckets`` numbers
    sieve = bloom.build(asked, "normalized_title", told["n"], cfg.bloom_bits_per_key, cfg.bloom_most_bits)
    if sieve is not None:
        kept = sieve.thinned(kept, "normalized_title")
    ids = F.slice(F.array_sort(F.flatten(F.collect_list("exact_ids"))), 1, rows)
    merged = kept.groupBy("normalized_title").agg(F.sum("exact_total").alias("exact_total"), ids.alias("exact_ids"))
    return asked.join(merged, "normalized_title").drop("normalized_title")
