"""From raw documents to token ids: language, near duplicates, personal data, source mix, tokens.

Each stage is one operator of ``titlesieve.llm`` applied to all that its predecessor kept. All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from titlesieve.llm import bpe, common, langid, mixing, neardup, pii
from titlesieve.session import ship_package

RANKS = "byte_bpe_multi_50k.tiktoken"

#: No SQL can state compression, MinHash components or byte-level BPE; tests/llm compares with brute force.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear, with ``lang`` as predicted. The dictionaries come from the labelled
    rows that are not held out.

    Null texts and texts without a letter have no clear language and go, and so does every row where nothing can be
    learned; repeated rows are judged alike; an empty table gives an empty one. ``_stage_language`` is reserved."""
    model = langid.fit(docs.filter(~F.coalesce(langid.held_out(F.col("doc_id")), F.lit(False))))
    told = langid.predict(docs, model, out="_stage_language").filter("NOT _stage_language.rejected")
    return told.withColumn("lang", F.col("_stage_language.lang_pred")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five words a shingle, a similarity of 0.8 or more.

    Documents without words all stay; of repeated rows with words one stays; the smallest doc_id of a group stands for it,
    a null one only where all are null; an empty table gives an empty one. Names beginning with ``_nd_`` are reserved."""
    return neardup.deduplicated(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates for personal data and ``n_chars`` of the new text. Null and empty texts stay as they are,
    repeated rows change alike, an empty table gives an empty one. Names beginning with ``_pii_`` are reserved."""
    return pii.pseudonymised(docs).select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix uses them. A null source is a source of its own; rows equal in doc_id and text
    are used alike; an empty table gives an empty one. Names beginning with ``_mix_`` are reserved."""
    return mixing.mixture(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and the ids of each whole text; ``decodes`` tells that they give it back.
    Null and empty texts have no ids and give back the empty text; repeated rows repeat; other columns are left out."""
    path, pattern = public_tokenizers.path(RANKS), public_tokenizers.PATTERN
    encoded = bpe.encode(docs.select("doc_id", "lang", "source", "text"), path, pattern)
    told = encoded.select("doc_id", "lang", "source", "ids", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("was"))
    # encoding ends before decoding begins: a task then has one Python worker and its batches, not two
    decoded = bpe.decode(common.cut(told), path, pattern)
    return decoded.select("doc_id", "lang", "source", (F.length("ids") / 4).cast("long").alias("n_tokens"), "ids",
                          (F.md5("decoded") == F.col("was")).alias("decodes"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("source_mix", source_mix),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is kept as a table in the checkpoint folder."""
    from uuid import uuid4

    from titlesieve.session import ensure_checkpoint_dir

    ship_package(spark)
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
