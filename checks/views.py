"""Spark views over the supplied tables that give the screening engine a corpus to work on."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from titlesieve.functions.phonetic import phonetic_code
from titlesieve.functions.text import normalize_domain, normalize_title
from titlesieve.functions.vectors import unit
from titlesieve.plans.derived import append_records, build_derived
from titlesieve.plans.index import index_meta
from titlesieve.plans.screen import Library
from titlesieve.session import cut_lineage, ensure_checkpoint_dir, ship_package
from titlesieve.sources.store import TitleStore


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def vector_rows(spark: SparkSession, sf: str) -> int:
    return table(spark, sf, "embeddings").count()


def raw_titles(spark: SparkSession, sf: str) -> DataFrame:
    """Title records found in the raw pages."""
    html = F.col("html")
    return table(spark, sf, "pages").select(
        F.col("page_id").alias("id"),
        F.trim(F.regexp_extract(html, "<title>([^<]*)</title>", 1)).alias("title"),
        F.regexp_extract(html, '<html lang="([a-z]+)"', 1).alias("language"),
        F.regexp_extract(html, "<p>(?:<[a-z]+>)*([^<.]*)", 1).alias("description"),
        F.when(F.col("page_id") % 11 == 5, "pending")
        .when(F.col("page_id") % 11 == 3, "approved")
        .otherwise("active")
        .alias("record_status"),
    ).withColumn("raw_domain", F.concat(F.upper("language"), F.lit(" - "), (F.col("id") % 7).cast("string")))


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    ship_package(spark)
    n = vector_rows(spark, sf)
    labels = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("_vec"), F.col("label").alias("cluster_id")
    )
    return (
        raw_titles(spark, sf)
        .withColumn("_vec", F.col("id") % n)
        .join(labels, "_vec", "left")
        .drop("_vec")
        .withColumn("normalized_title", normalize_title(F.col("title")))
        .withColumn("domain", normalize_domain(F.col("raw_domain")))
        .withColumn("phonetic_code", phonetic_code(F.col("title"), F.col("normalized_title")))
    )


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    n = vector_rows(spark, sf)
    return (
        table(spark, sf, "pages")
        .select(F.col("page_id").alias("id"), (F.col("page_id") % n).alias("vec_id"))
        .join(table(spark, sf, "embeddings"), "vec_id")
        .select("id", F.col("id").alias("position"), unit(F.col("embedding")).alias("embedding"),
                F.col("label").alias("cluster_id"))
    )


def centroids(spark: SparkSession, sf: str) -> DataFrame:
    """Mean vector per label, a fixed cluster model."""
    source = vectors(spark, sf)
    width = 64
    means = [
        F.round(F.avg(F.element_at("embedding", i + 1).cast("double")), 6).alias(f"m{i}") for i in range(width)
    ]
    grouped = source.groupBy("cluster_id").agg(F.count("*").alias("size"), *means)
    return grouped.select(
        "cluster_id", F.array(*[f"m{i}" for i in range(width)]).cast("array<float>").alias("centroid"), "size"
    )


def proposals(spark: SparkSession, sf: str) -> DataFrame:
    """Every page's title, altered in one of six ways, with the next page's vector."""
    ship_package(spark)
    n = vector_rows(spark, sf)
    items = table(spark, sf, "benchmark")
    n_items = items.count()
    phrases = items.select(
        F.col("item_id").alias("_item"),
        F.array_join(F.slice(F.split("text", r"\s+"), 1, 6), " ").alias("phrase"),
    )
    embedded = table(spark, sf, "embeddings").select(F.col("vec_id").alias("_vec"), "embedding")
    words = F.split("title", " ")
    kind = F.col("id") % 6
    changed = (
        F.when(kind == 1, F.upper("title"))
        .when(kind == 2, F.array_join(F.reverse(words), " "))
        .when(kind == 3, F.array_join(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), " "))
        .when(kind == 4, F.concat("title", F.lit(" Variation "), F.col("id").cast("string")))
        .when(kind == 5, F.col("phrase"))
        .otherwise(F.col("title"))
    )
    return (
        raw_titles(spark, sf)
        .withColumn("_vec", (F.col("id") + 1) % n)
        .withColumn("_item", F.col("id") % n_items)
        .join(embedded, "_vec")
        .join(phrases, "_item")
        .select(
            F.col("id").alias("proposal_id"),
            F.col("id").alias("seq"),
            changed.alias("title"),
            F.col("raw_domain").alias("domain"),
            "language",
            "description",
            F.lit(None).cast("string").alias("contact_info"),
            "embedding",
        )
    )


_libraries: dict[tuple[str, str], Library] = {}


def library(spark: SparkSession, sf: str) -> Library:
    """Corpus, index and cluster model as stored tables, built once per session and scale."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _libraries:
        _libraries[key] = Library(
            cut_lineage(corpus(spark, sf)), cut_lineage(vectors(spark, sf)), cut_lineage(centroids(spark, sf))
        )
    return _libraries[key]


def store_of(spark: SparkSession, sf: str) -> TitleStore:
    """The library in a store, its corpus come in two appends."""
    store, built = TitleStore(spark, f"{ensure_checkpoint_dir(spark)}/library-{uuid.uuid4().hex}"), library(spark, sf)
    store.replace("vectors", built.vectors)
    vectors = store.read("vectors")
    store.replace("index_meta", index_meta(vectors, "fixture", vectors.select(F.size("embedding")).first()[0], {"model": "fixture"}))
    store.replace("centroids", built.centroids)
    store.replace("corpus", built.corpus.filter("id % 3 <> 0"))
    build_derived(store)
    append_records(store, built.corpus.filter("id % 3 = 0"))
    return store


def sheet(spark: SparkSession, sf: str) -> DataFrame:
    """A raw title table with blanks, "nan" cells and repeats, in ``doc_id`` order."""
    ship_package(spark)
    lines = F.split("text", "\n")
    doc = F.col("doc_id")
    return table(spark, sf, "documents").select(
        "doc_id",
        F.when(doc % 37 == 0, F.lit(None)).when(doc % 41 == 0, "nan").otherwise(F.get(lines, F.lit(0))).alias("titles"),
        F.get(lines, F.lit(1)).alias("description"),
        F.when(doc % 29 != 0, F.concat("source", F.lit(" - "), "lang")).alias("domain"),
        F.nullif(F.regexp_extract("text", "[A-Za-z0-9._-]+@[A-Za-z0-9.-]+", 0), F.lit("")).alias("contact_info"),
    )
