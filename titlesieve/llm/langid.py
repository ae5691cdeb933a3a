"""Language identification by compression: a text belongs to the language whose sample, given to zstandard
as a raw-content dictionary, lets it be encoded smallest. Narrow margins are marked as rejected."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNKNOWN = "und"


@dataclass(frozen=True)
class LanguageId:
    """``sample_rows`` rows a language and ``sample_chars`` characters of each bound the sample that a
    dictionary is made of; predictions always read whole texts, in blocks of ``block`` bytes."""

    sample_rows: int = 100
    sample_chars: int = 600
    level: int = 9
    block: int = 4096
    min_margin: float = 0.01
    seed: int = 11


@dataclass(frozen=True)
class Dictionaries:
    """Languages in order of their number of labelled rows (ties by name), which decides equal sizes."""

    languages: tuple[str, ...]
    contents: tuple[bytes, ...]


def letters(text: Column) -> Column:
    """Lower-case letters with one space for whatever lies between."""
    return F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"\P{L}+", " "))


def fit(labelled: DataFrame, cfg: LanguageId = LanguageId()) -> Dictionaries:
    """Dictionaries from ``labelled`` (doc_id, text, lang); rows without text or lang are left out. The
    sample of a language are its first rows in a seeded order, so it does not depend on partitions."""
    rows = labelled.select("doc_id", "text", "lang").filter("text IS NOT NULL AND lang IS NOT NULL")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    picked = rows.select("lang", F.xxhash64(F.lit(cfg.seed), F.col("doc_id").cast("string")).alias("place"),
                         F.substring("text", 1, 4 * cfg.sample_chars).alias("head"))
    picked = picked.filter(F.col("head").rlike(r"\p{L}"))
    order = Window.partitionBy("lang").orderBy("place", "head")
    picked = picked.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= cfg.sample_rows)
    heads = picked.select("lang", "n", F.substring(F.trim(letters(F.col("head"))), 1, cfg.sample_chars).alias("head")).collect()
    languages = sorted({r["lang"] for r in heads}, key=lambda x: (-counts[x], x))
    by = {x: [r["head"] for r in sorted(heads, key=lambda r: -r["n"]) if r["lang"] == x] for x in languages}
    return Dictionaries(tuple(languages), tuple("\n".join(by[x]).encode() for x in languages))


def predict(docs: DataFrame, model: Dictionaries, cfg: LanguageId = LanguageId(), text: str = "text", out: str = "language") -> DataFrame:
    """``docs`` with ``out``: struct of ``lang_pred``, ``score`` (share by which the runner-up is larger,
    0 to 1) and ``rejected`` (no letter, or a margin below ``min_margin``). Only the text is read. Null
    texts, texts without a letter and any text under a model without languages are ``und`` with score 0."""

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def classify(texts: pd.Series) -> pd.DataFrame:
        import zstandard

        def coder(content: bytes):
            sample = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            sample.precompute_compress(level=cfg.level)
            return zstandard.ZstdCompressor(
                level=cfg.level, dict_data=sample, write_content_size=False, write_checksum=False, write_dict_id=False).compress

        coders, rows = [coder(c) for c in model.contents], []
        for t in texts:
            data = t.strip().encode()
            if not data or not coders:
                rows.append((UNKNOWN, 0.0, True))
                continue
            blocks = [data[i:i + cfg.block] for i in range(0, len(data), cfg.block)]
            sizes = [sum(len(code(b)) for b in blocks) for code in coders]
            best, second = min(range(len(sizes)), key=lambda i: (sizes[i], i)), sorted(sizes)[1:2]
            score = (second[0] - sizes[best]) / second[0] if second else 1.0
            rows.append((model.languages[best], score, score < cfg.min_margin))
        return pd.DataFrame(rows, columns=["lang_pred", "score", "rejected"])

    # marked so that a filter on the result does not run it a second time
    return docs.withColumn(out, classify.asNondeterministic()(letters(F.col(text))))


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def op2(docs: DataFrame, cfg: LanguageId = LanguageId()) -> DataFrame:
    """The contract of the query: learned from the rows that are not held out, predicted for all."""
    rows = docs.select("doc_id", "text", "lang").withColumn("held_out", F.coalesce(held_out(F.col("doc_id")), F.lit(False)))
    model = fit(rows.filter("NOT held_out"), cfg)
    return predict(rows.select("doc_id", "text", "held_out"), model, cfg).select("doc_id", "held_out", "language.*")
