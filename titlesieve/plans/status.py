"""Read-only reports: index health, corpus statistics, latency summary, benchmark titles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import round_exact
from ..operators.ordinal import with_running_counts
from ..operators.rows import one_row
from ..session import cut_lineage
from ..sources.reports import write_report
from ..sources.store import TitleStore

LATENCY_TARGET_MS = 500.0

# Fixed values: (title, domain) of the benchmark proposals, used in turn.
BENCHMARK_TITLES = (
    ("Climate Change News", "news-environment"),
    ("Tech Innovations Daily", "news-technology"),
    ("Global Financial Review", "business"),
    ("Sports Weekly Digest", "news-sports"),
    ("Health & Wellness Magazine", "health"),
    ("Artificial Intelligence Frontier", "technology"),
    ("National Geographic Science", "science"),
    ("International Policy Journal", "politics"),
    ("Entertainment Tonight Buzz", "entertainment"),
    ("Education Horizons Today", "education"),
)


def index_health(corpus: DataFrame, vectors: DataFrame, centroids: DataFrame, meta: DataFrame | None = None) -> DataFrame:
    """One row: sizes, consistency of the index with itself and with the corpus, overall status, the name of the
    encoder as the index's ``meta`` has it (null without) and the time of the report."""
    index = vectors.agg(
        F.count("*").alias("vector_count"),
        F.count_distinct("position").alias("positions"),
        F.count_distinct("id").alias("ids"),
    )
    orphans = vectors.join(corpus.select("id"), "id", "left_anti").agg(F.count("*").alias("orphan_vectors"))
    clusters = centroids.agg(F.count("*").alias("cluster_count"))
    if meta is None:
        named = clusters.select(F.lit(None).cast("string").alias("embedding_model"))
    else:
        named = meta.agg(F.max_by("model_name", "updated_at").alias("embedding_model"))
    loaded = (F.col("vector_count") > 0) & (F.col("positions") == F.col("vector_count"))
    return one_row(index, orphans, clusters, named).select(
        F.when(loaded, "healthy").otherwise("degraded").alias("status"),
        loaded.alias("index_loaded"),
        "vector_count",
        (F.col("ids") == F.col("vector_count")).alias("ids_unique"),
        "orphan_vectors",
        "cluster_count",
        "embedding_model",
        F.current_timestamp().alias("checked_at"),
    )


def store_health(store: TitleStore) -> DataFrame:
    """:func:`index_health` of a store's current versions; a store without an index is degraded."""
    return index_health(*[store.read(t) for t in ("corpus", "vectors", "centroids", "index_meta")])


def corpus_statistics(corpus: DataFrame) -> DataFrame:
    """Rows per domain, cluster, status and language in one pass: (dimension, value, rows)."""
    facts = F.array(*[
        F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value"))
        for c in ("domain", "cluster_id", "record_status", "language")
    ])
    return (
        corpus.select(F.explode(facts).alias("f"))
        .groupBy("f.dimension", "f.value")
        .agg(F.count("*").alias("rows"))
    )


def percentiles(rows: DataFrame, column: str, shares: tuple[float, ...]) -> DataFrame:
    """One row with ``p0``, ``p1``, ...: interpolated percentiles of the non-null values, null without any.
    Distinct values are counted and ranked in parallel; no task holds them all."""
    counted = rows.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("_n"))
    counted = cut_lineage(counted)
    total = counted.agg(F.sum("_n")).first()[0] or 0
    ranked = with_running_counts(counted, column, {"_upto": (F.col("_n"), 1)})

    def at(place: int) -> Column:
        return F.max(F.when((F.col("_upto") > place) & (F.col("_upto") - F.col("_n") <= place), F.col(column)))

    out = []
    for i, share in enumerate(shares):
        exact = share * max(total - 1, 0)
        low = int(exact)
        high = min(low + 1, max(total - 1, 0))
        out.append((at(low) * (1 - (exact - low)) + at(high) * (exact - low)).alias(f"p{i}"))
    return ranked.agg(*out)


def latency_summary(timings: DataFrame, ms: str) -> DataFrame:
    """Mean, median, high percentiles (interpolated), extremes and whether the target is met."""
    totals = timings.agg(
        F.count(ms).alias("query_count"), F.avg(ms).alias("mean"), F.min(ms).alias("low"), F.max(ms).alias("high"),
    )
    facts = one_row(totals, percentiles(timings, ms, (0.5, 0.95, 0.99)))

    def shown(c: Column, name: str) -> Column:
        return round_exact(c, 2).alias(name)

    return facts.select(
        "query_count",
        shown(F.col("mean"), "mean_ms"),
        shown(F.col("p0"), "median_ms"),
        shown(F.col("p1"), "p95_ms"),
        shown(F.col("p2"), "p99_ms"),
        shown(F.col("low"), "min_ms"),
        shown(F.col("high"), "max_ms"),
        (F.col("p1") < LATENCY_TARGET_MS).alias("meets_target_under_500ms"),
    )


def write_latencies(timings: DataFrame, ms: str, folder: str) -> None:
    """The summary as report files."""
    write_report(latency_summary(timings, ms), folder)


def benchmark_proposals(numbers: DataFrame, index: str) -> DataFrame:
    """A benchmark title and domain for each 0-based ``index``."""
    titles = F.array(*[F.lit(t) for t, _ in BENCHMARK_TITLES])
    domains = F.array(*[F.lit(d) for _, d in BENCHMARK_TITLES])
    turn = (F.col(index) % len(BENCHMARK_TITLES)).cast("int")
    number = (F.col(index) + 1).cast("string")
    return numbers.select(
        F.col(index),
        F.concat(F.get(titles, turn), F.lit(" Variation "), number).alias("title"),
        F.get(domains, turn).alias("domain"),
    )
