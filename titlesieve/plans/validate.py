"""Dataset validation: checks, profile and report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ScreeningConfig
from ..operators.profile import domain_counts, profile_counts, with_validity
from ..operators.rows import one_row
from ..session import ship_package
from ..sources.reports import write_report
from ..sources.sheets import open_sheet

_COUNTS = ("total_rows", "valid_titles_count", "blank_titles_count", "missing_descriptions_count",
           "missing_contact_info_count", "duplicate_raw_titles_count", "duplicate_normalized_titles_count",
           "min_title_length", "max_title_length", "empty_domains_count")


def profile_report(raw: DataFrame, cfg: ScreeningConfig = ScreeningConfig()) -> DataFrame:
    """The one-row report of a raw table. ``domain_counts`` holds one entry per distinct domain; when
    there are more than ``max_map_entries`` it is NULL and the whole is left to ``domain_counts()``,
    which returns it as a table."""
    ship_package(raw.sparkSession)
    listed = domain_counts(raw).limit(cfg.max_map_entries + 1).agg(
        F.collect_list(F.struct("domain", "rows")).alias("entries")
    )
    domains = listed.select(
        F.when(F.size("entries") <= cfg.max_map_entries, F.map_from_entries(F.array_sort("entries")))
        .alias("domain_counts")
    )
    return with_validity(one_row(profile_counts(raw), domains), cfg)


def validate_dataset(
    spark: SparkSession, path: str, fmt: str = "csv", cfg: ScreeningConfig = ScreeningConfig(),
    sheet_name: str = "Combined Dataset", report_folder: str | None = None, **options: str,
) -> DataFrame:
    """Open a raw table and report on it. A missing file or column ends the check early, without a
    written report."""
    raw, state = open_sheet(spark, path, fmt, **options)
    head = {
        "dataset_path": F.lit(path),
        "sheet_name": F.lit(sheet_name),
        "validation_timestamp": F.current_timestamp(),
        **{k: F.lit(state[k]) for k in ("file_exists", "sheet_exists", "columns_valid")},
    }
    if raw is None:
        zero = {c: F.lit(0).cast("long") for c in _COUNTS}
        early = spark.range(1).select(
            *[v.alias(k) for k, v in {**head, **zero}.items()],
            F.create_map().cast("map<string,bigint>").alias("domain_counts"),
            F.lit(False).alias("is_valid"),
            F.array(*[F.lit(e) for e in state["errors"]]).alias("errors"),
        )
        return early
    report = profile_report(raw, cfg).select(
        *[v.alias(k) for k, v in head.items()], *_COUNTS, "domain_counts", "is_valid", "errors"
    )
    if report_folder:
        write_report(report, report_folder)
        domain_counts(raw).write.mode("overwrite").parquet(f"{report_folder}/domain_counts")
    return report
