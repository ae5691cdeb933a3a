"""One-row report sinks: JSON, and CSV with nested values encoded as JSON text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType


def flatten_nested(df: DataFrame) -> DataFrame:
    nested = (ArrayType, MapType, StructType)
    return df.select(*[
        F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in df.schema
    ])


def write_report(df: DataFrame, folder: str) -> None:
    """``df`` is one row by construction, so one file of each kind is one small task."""
    df.coalesce(1).write.mode("overwrite").json(f"{folder}/json")
    flatten_nested(df).coalesce(1).write.mode("overwrite").option("header", True).csv(f"{folder}/csv")
