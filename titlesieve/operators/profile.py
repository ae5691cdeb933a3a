"""Profile of a raw title table: counts, lengths, duplicates, domains, validity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ScreeningConfig
from ..functions.text import is_blank, is_blank_or_nan, normalize_domain, normalize_title, strip


def _missing(c: Column) -> Column:
    """Blank, or exactly "nan" in any case (padding keeps it a value)."""
    return is_blank(c) | (F.lower(c) == "nan")


def domain_counts(raw: DataFrame) -> DataFrame:
    """Rows per normalised domain, rows with blank titles included."""
    return raw.groupBy(normalize_domain(F.col("domain")).alias("domain")).agg(F.count("*").alias("rows"))


def profile_counts(raw: DataFrame) -> DataFrame:
    """All scalar facts of the table in one aggregation."""
    valid = ~is_blank_or_nan(F.col("titles"))
    rows = raw.select(
        F.when(valid, strip(F.col("titles"))).alias("title"),
        _missing(F.col("description")).alias("no_description"),
        _missing(F.col("contact_info")).alias("no_contact"),
        normalize_domain(F.col("domain")).isin("unknown", "").alias("no_domain"),
    ).withColumn("normal", F.when(F.col("title").isNotNull(), normalize_title(F.col("title"))))
    return rows.agg(
        F.count("*").alias("total_rows"),
        F.count("title").alias("valid_titles_count"),
        F.count_if(F.col("title").isNull()).alias("blank_titles_count"),
        F.count_if("no_description").alias("missing_descriptions_count"),
        F.count_if("no_contact").alias("missing_contact_info_count"),
        (F.count("title") - F.count_distinct("title")).alias("duplicate_raw_titles_count"),
        (F.count("normal") - F.count_distinct("normal")).alias("duplicate_normalized_titles_count"),
        F.coalesce(F.min(F.length("title")), F.lit(0)).alias("min_title_length"),
        F.coalesce(F.max(F.length("title")), F.lit(0)).alias("max_title_length"),
        F.count_if("no_domain").alias("empty_domains_count"),
    )


def with_validity(counts: DataFrame, cfg: ScreeningConfig) -> DataFrame:
    """Errors found in the profile and whether there are none."""
    short = F.format_string(
        f"Valid title count (%d) is less than required minimum ({cfg.min_valid_titles}).", F.col("valid_titles_count")
    )
    errors = F.array_compact(F.array(F.when(F.col("valid_titles_count") < cfg.min_valid_titles, short)))
    return counts.withColumn("errors", errors).withColumn("is_valid", F.size("errors") == 0)
