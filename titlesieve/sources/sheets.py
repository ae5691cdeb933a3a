"""Raw title tables in files: scan, header clean-up, required columns."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .schemas import RAW_COLUMNS

POSITION = "source_position"

# Cells that a spreadsheet reader takes for missing, compared as written.
MISSING_CELLS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA",
    "NULL", "NaN", "None", "n/a", "nan", "null",
)


def _load(spark: SparkSession, path: str, fmt: str, options: dict[str, str]) -> DataFrame:
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.options(header=True, inferSchema=False, quote='"', escape='"')
    if fmt == "json":
        reader = reader.options(primitivesAsString=True)
    return reader.options(**options).load(path)


def _cells(df: DataFrame, fmt: str, missing: tuple[str, ...] | None) -> list[Column]:
    """Every column as text under its trimmed, lower-cased header."""
    if missing is None:
        missing = MISSING_CELLS if fmt == "csv" else ()

    def cell(name: str) -> Column:
        text = F.col(f"`{name}`").cast("string")
        return F.when(~text.isin(*missing), text) if missing else text

    return [cell(c).alias(c.strip().lower()) for c in df.columns]


def read_sheet(
    spark: SparkSession, path: str, fmt: str = "csv", missing: tuple[str, ...] | None = None, **options: str
) -> DataFrame:
    """Scan a file set as text columns with trimmed, lower-cased headers. Cells spelt as one of ``missing`` are
    null, all others are kept as written: nothing is inferred. Formats that know nulls of their own (all but csv)
    have no such spellings unless they are given."""
    df = _load(spark, path, fmt, options)
    return df.select(*_cells(df, fmt, missing))


def read_positioned(
    spark: SparkSession, path: str, fmt: str = "csv", missing: tuple[str, ...] | None = None, **options: str
) -> DataFrame:
    """:func:`read_sheet` with ``source_position``: the place of a row, from 0, by path of its file, then by its
    place in the file. It depends on the files alone, not on how they are cut or packed into tasks.

    A task reads a block of a file row by row, so scan ids rise by one inside a block. They are fixed by a
    checkpoint; the table of blocks has one row a split of the scan, which is what the driver plans with."""
    df = _load(spark, path, fmt, options)
    source = df.metadataColumn("_metadata")
    scanned = cut_lineage(df.select(
        *_cells(df, fmt, missing), source["file_path"].alias("_file"), source["file_block_start"].alias("_block"),
        F.monotonically_increasing_id().alias("_scan"),
    ))
    blocks = scanned.groupBy("_file", "_block").agg(F.min("_scan").alias("_first"), F.count("*").alias("_rows"))
    before = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("_file", "_block", (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    return (
        scanned.join(starts, ["_file", "_block"])
        .withColumn(POSITION, F.col("_scan") + F.col("_shift"))
        .drop("_file", "_block", "_scan", "_shift")
    )


def missing_columns(df: DataFrame) -> list[str]:
    return [c for c in RAW_COLUMNS if c not in df.columns]


def open_sheet(
    spark: SparkSession, path: str, fmt: str = "csv", missing: tuple[str, ...] | None = None, **options: str
) -> tuple[DataFrame | None, dict]:
    """The sheet, or None with the state of the checks that ended the scan early."""
    state = {"file_exists": False, "sheet_exists": False, "columns_valid": False, "errors": []}
    try:
        df = read_sheet(spark, path, fmt, missing, **options)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            state["errors"].append(f"Dataset file not found at: {path}")
        else:
            state["file_exists"] = True
            state["errors"].append(f"Failed to read dataset workbook/sheet: {e.getMessage()}")
        return None, state
    state["file_exists"] = state["sheet_exists"] = True
    absent = missing_columns(df)
    if absent:
        state["errors"].append(f"Missing required columns: {absent}. Found columns: {df.columns}")
        return None, state
    state["columns_valid"] = True
    return df, state
