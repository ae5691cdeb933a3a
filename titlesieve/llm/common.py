"""What the operators of this folder share: table access, lineage cuts, words, bounded seeded ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, ship_package

#: A word is a run of characters other than these (fixed by the contract of the queries).
SPACE = r"[\x20\x09-\x0D]"
_SPACES = " \t\n\x0b\x0c\r"
_RANK_BUCKETS = 4096


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def words(text: Column) -> Column:
    """Words of a text; none for a null."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(_SPACES))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, SPACE + "+"))


def n_words(text: Column) -> Column:
    """Number of words."""
    return F.size(words(text)).cast("long")


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the folder ``spark.checkpoint.dir`` names."""
    return cut_lineage(df)


def seeded_rank(df: DataFrame, group: list[str], order: list[Column], name: str) -> DataFrame:
    """Adds ``name``: 0-based rank within ``group`` by ``order`` behind a hash bucket of it. A group may
    hold any share of the rows: only its hash buckets are sorted, each in a task of its own, and the
    counts of buckets, at most 4096 a group, give their offsets. Null keys form a group of their own;
    rows equal in ``order`` may swap ranks and should then be alike."""
    bucket = "_rank_bucket"
    marked = df.withColumn(bucket, F.pmod(F.xxhash64(*order), F.lit(_RANK_BUCKETS)).cast("int"))
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        marked.groupBy(*group, bucket).agg(F.count("*").alias("_in_bucket"))
        .withColumn("_start", F.coalesce(F.sum("_in_bucket").over(before), F.lit(0)))
        .drop("_in_bucket")
    )
    ranked = marked.withColumn("_within", F.row_number().over(Window.partitionBy(*group, bucket).orderBy(*order)) - 1)
    same = [ranked[c].eqNullSafe(starts[c]) for c in [*group, bucket]]
    on = same[0]
    for s in same[1:]:
        on = on & s
    joined = ranked.join(starts, on, "left").drop(*[starts[c] for c in [*group, bucket]])
    return joined.withColumn(name, (F.col("_start") + F.col("_within")).cast("long")).drop("_start", "_within", bucket)
