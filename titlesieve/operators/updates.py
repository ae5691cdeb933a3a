"""Keyed column updates over immutable tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def update_column(table: DataFrame, updates: DataFrame, column: str, key: str = "id") -> DataFrame:
    """New values replace old ones by key; unlisted rows keep theirs, unknown keys change nothing. Of a key
    listed several times the largest value counts, so that no row is multiplied."""
    fresh = updates.groupBy(key).agg(F.max(column).alias("_new"))
    order = table.columns
    return (
        table.join(fresh, key, "left")
        .withColumn(column, F.coalesce("_new", column))
        .select(*order)
    )


def updated_count(table: DataFrame, updates: DataFrame, key: str = "id") -> DataFrame:
    return updates.join(table.select(key), key, "left_semi").agg(F.count("*").alias("updated"))
