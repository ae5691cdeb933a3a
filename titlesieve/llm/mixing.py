"""Mixing sources to target weights by fitting budgets of words exactly.

Each source gets a budget by its weight. Whole passes over the source cover what they can; for the rest
documents are counted by exact length, a share of each length is taken, and what this leaves open is filled
by a bounded subset sum over lengths. The documents of a length are then chosen in a seeded order.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, n_words, seeded_rank


@dataclass(frozen=True)
class Mixing:
    weights: tuple[int, ...] = (5, 2, 1)  # of the sources in order of their names, repeating
    share: float = 1.0  # of all words that the mix has
    most: int = 3  # times that a document may be used
    window: int = 4096  # words of the budget that the subset sum decides
    seed: int = 3


def budgets(sources: DataFrame, cfg: Mixing) -> DataFrame:
    """``sources`` (source, source_size) with ``target``: words by weight, at most ``most`` times the
    source's size, the excess shared by weight among the others. One row a source; null comes last.

    In order of size over weight the capped sources come first, so one pass finds the level at which the
    rest shares what the capped ones leave."""
    named = Window.orderBy(F.asc_nulls_last("source"))
    weight = F.element_at(F.array(*map(F.lit, cfg.weights)), (F.row_number().over(named) - 1) % len(cfg.weights) + 1).cast("double")
    s = sources.withColumn("w", weight).withColumn("cap", F.col("source_size") * F.lit(float(cfg.most)))
    ordered = Window.orderBy(F.col("cap") / F.col("w"), F.asc_nulls_last("source"))
    onwards, before = ordered.rowsBetween(0, Window.unboundedFollowing), ordered.rowsBetween(Window.unboundedPreceding, -1)
    everywhere = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("level", (cfg.share * F.sum("source_size").over(everywhere) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(onwards))
    s = s.withColumn("open", F.when(F.col("cap") >= F.col("level") * F.col("w"), F.col("level")))
    level = F.first("open", ignorenulls=True).over(everywhere)
    return s.withColumn("target", F.coalesce(F.least("cap", F.col("w") * level), F.col("cap"))).select("source", "source_size", "target")


def subset_sum(items: list[tuple[int, int]], budget: int) -> dict[int, int]:
    """How many of each size to take, from (size, available), so that the sum comes as near below ``budget``
    as possible. Sums are bits of one integer; counts are split into powers of two."""
    reach, steps, full = 1, [], (1 << (budget + 1)) - 1
    for size, count in items:
        unit = 1
        while count > 0 and size <= budget:
            take = min(unit, count)
            steps.append((size, take, reach))
            reach = (reach | reach << size * take) & full
            count, unit = count - take, 2 * unit
    at, taken = reach.bit_length() - 1, {}
    for size, take, had in reversed(steps):
        if not had >> at & 1:
            at -= size * take
            taken[size] = taken.get(size, 0) + take
    return taken


def fit_lengths(counts: dict[int, int], budget: int, window: int) -> dict[int, int]:
    """Documents to take of each length (``counts``: length to documents, lengths above 0) so that their
    words sum to ``budget`` or as near as the lengths allow."""
    total, left, out = sum(n * c for n, c in counts.items()), budget, {}
    lengths = sorted(counts, reverse=True)
    ahead = total
    for n in lengths:  # long to short; what a length leaves open goes to the shorter ones
        want = left * counts[n] / ahead if ahead else 0
        out[n] = min(counts[n], int(want), left // n)
        left, ahead = left - n * out[n], ahead - n * counts[n]
    for n in reversed(lengths):  # give back short documents, so that the subset sum has a choice
        if left >= window:
            break
        back = min(out[n], max((window - left) // n, 0), 8)
        out[n], left = out[n] - back, left + n * back
    free = [(n, counts[n] - out[n]) for n in lengths if counts[n] > out[n] and n <= left]
    most = max(window, 0)
    for n, c in free:  # a rest beyond the window goes to long documents first
        k = min(c, max(left - most, 0) // n)
        out[n], left = out[n] + k, left - n * k
    free = [(n, counts[n] - out[n]) for n in lengths if counts[n] > out[n] and n <= left]
    for n, k in subset_sum(free, left).items():
        out[n], left = out[n] + k, left - n * k
    short = min((n for n in lengths if out[n] < counts[n]), default=0)
    if 0 < short - left < left:  # one more comes nearer
        out[short] += 1
    return out


def plan(sized: DataFrame, cfg: Mixing) -> DataFrame:
    """For each (source, size) of ``sized``: source_size, target, passes over all documents and ``extra``
    documents that are used once more. A source's task holds one number for each distinct length."""
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    lengths = sized.groupBy("source", "size").agg(F.count("*").alias("n"))
    b = budgets(sources, cfg).withColumnRenamed("source", "s")
    rows = lengths.join(b, F.col("source").eqNullSafe(F.col("s"))).drop("s")

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        size, target = int(group["source_size"].iloc[0]), float(group["target"].iloc[0])
        passes = min(int(target // size), cfg.most) if size else 0
        rest = round(target - passes * size) if passes < cfg.most else 0
        extra = fit_lengths({int(n): int(c) for n, c in zip(group["size"], group["n"]) if n > 0}, rest, cfg.window)
        return group.assign(passes=passes, extra=[extra.get(int(n), 0) for n in group["size"]])

    kind = sized.schema["source"].dataType.simpleString()
    return rows.groupBy("source").applyInPandas(
        fit, f"source {kind}, size long, n long, source_size long, target double, passes long, extra long")


def mix(docs: DataFrame, cfg: Mixing = Mixing()) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text, source; nothing else is read): doc_id, ``mark`` (hash
    of its text), size in words, source_size, target (words its source should give) and ``copies``, how often
    the mix uses it.

    Null sources are one source, the last. Null, empty or wordless texts have size 0 and no copies. Repeated
    rows count each for itself. A source's words miss its target by less than its shortest unused document;
    documents too long for what is left are only used where that comes nearer. An empty table gives an empty
    result.
    """
    rows = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("mark"))
    rows = cut(rows)
    fitted = cut(plan(rows.select("source", "size"), cfg)).select(
        F.col("source").alias("s"), F.col("size").alias("z"), "source_size", "target", "passes", "extra")
    order = [F.xxhash64(F.lit(cfg.seed), F.col("doc_id").cast("string"), F.col("mark")), F.col("doc_id").cast("string"), F.col("mark")]
    ranked = seeded_rank(rows, ["source", "size"], order, "place")
    joined = ranked.join(fitted, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")))
    copies = F.when(F.col("size") == 0, 0).otherwise(F.col("passes") + (F.col("place") < F.col("extra")).cast("long"))
    return joined.select("doc_id", "mark", "size", "source_size", "target", copies.cast("long").alias("copies"))


def mixture(docs: DataFrame, cfg: Mixing = Mixing()) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as ``mix`` uses it. Rows equal in doc_id and text are
    all used as often as the most used of them. Columns beginning with ``_mix_`` are reserved."""
    used = mix(docs, cfg).filter("copies > 0").groupBy("doc_id", "mark").agg(F.max("copies").alias("copies"))
    used = used.select(F.col("doc_id").alias("_mix_id"), F.col("mark").alias("_mix_mark"), F.col("copies").alias("_mix_copies"))
    hit = docs.join(used, docs["doc_id"].eqNullSafe(used["_mix_id"]) & (F.xxhash64(docs["text"]) == used["_mix_mark"]))
    times = F.explode(F.sequence(F.lit(1), F.col("_mix_copies").cast("int")))
    return hit.select(*[docs[c] for c in docs.columns], times.alias("_mix_time")).select(*docs.columns)


def op3(docs: DataFrame) -> DataFrame:
    """The contract of the query."""
    return mix(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
