"""Putting one-row results side by side."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def one_row(*parts: DataFrame) -> DataFrame:
    """The columns of several one-row tables (global aggregates) as one row, without a join."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return stacked.agg(*[F.first(c, ignorenulls=True).alias(c) for c in stacked.columns])
