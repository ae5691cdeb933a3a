"""The registered query of each operator over its whole table, and the SQL it must equal where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, bpe, caps, codes, langid, mixing, neardup, oracles, pages, pii, quality, sharding, urls, whitening
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(oracle: str | None = None):
    def add(run):
        QUERIES[run.__name__] = run
        if oracle:
            ORACLES[run.__name__] = oracle
        return run

    return add


@register(oracles.quality())
def op1_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.op1(table(spark, folder, "documents"))


@register()
def op4_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return bpe.op4(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@register()
def op5_minhash_neardup(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, folder, "documents"), neardup.NearDup(words=4))


@register()
def op2_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return langid.op2(table(spark, folder, "documents"))


@register()
def op3_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.op3(table(spark, folder, "documents"))


@register()
def op10_kd_shards(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.op10(table(spark, folder, "documents"))


@register(oracles.urls())
def op7_link_trust(spark: SparkSession, folder: str) -> DataFrame:
    return urls.op7(table(spark, folder, "pages"))


@register()
def op9_collision_knn(spark: SparkSession, folder: str) -> DataFrame:
    return ann.op9(table(spark, folder, "embeddings"))


@register()
def op6_page_differencing(spark: SparkSession, folder: str) -> DataFrame:
    return pages.op6(table(spark, folder, "pages"))


@register()
def op8_pii_surrogates(spark: SparkSession, folder: str) -> DataFrame:
    return pii.op8(table(spark, folder, "documents"))


@register(oracles.codes())
def op11_gnat_codes(spark: SparkSession, folder: str) -> DataFrame:
    return codes.op11(table(spark, folder, "embeddings"))


@register(oracles.caps())
def op12_cap_filters(spark: SparkSession, folder: str) -> DataFrame:
    return caps.op12(table(spark, folder, "embeddings"))


@register()
def op13_chebyshev_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.op13(table(spark, folder, "embeddings"))
