"""Quality by weak supervision: rules vote or abstain, expectation-maximisation estimates how often each
votes on good and on bad documents, hence how accurate its votes are, and the posterior decides.

Only DataFrame functions are used. Votes are counted by pattern (a rule votes or abstains, so the
pattern table is bounded whatever the corpus), and every round of the estimation is one aggregate over it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, cut, words


@dataclass(frozen=True)
class Rule:
    """Votes ``says`` (good or bad) where the SQL condition over the measures holds, else abstains."""

    name: str
    says: str
    where: str


RULES = (
    Rule("symbols", "bad", "100 * n_symbols > 20 * n_words"),
    Rule("letters", "bad", "100 * n_letters < 70 * word_chars"),
    Rule("capitals", "bad", "100 * n_upper > 40 * n_letters"),
    Rule("marks", "bad", "10 * n_marks > n_words"),
    Rule("word_length", "bad", "word_chars > 14 * n_words OR word_chars < 2 * n_words"),
    Rule("repeats", "bad", "100 * n_repeat_words > 40 * n_words"),
    Rule("lines", "bad", "100 * n_dup_lines > 50 * n_lines"),
    Rule("prose", "good", "100 * n_stops BETWEEN 2 * n_words AND 34 * n_words AND 100 * (n_symbols + n_marks) <= 5 * n_words"),
    Rule("plain", "good", "100 * n_letters >= 85 * word_chars AND 100 * n_upper <= 20 * n_letters"),
    Rule("varied", "good", "100 * n_repeat_words <= 20 * n_words AND 100 * n_dup_lines <= 10 * n_lines"),
)


@dataclass(frozen=True)
class QualityModel:
    """Start values and rounds of the estimation. The start states that a rule that blames seldom
    fires on a good document and often on a bad one, and the reverse for a rule that praises; it fixes
    which class is called good. ``low`` and ``high`` bound every estimate."""

    rounds: int = 20
    prior: float = 0.85
    seldom: float = 0.03
    often: float = 0.4
    praise_good: float = 0.9
    praise_bad: float = 0.3
    threshold: float = 0.5
    low: float = 0.002
    high: float = 0.998


def measures(docs: DataFrame) -> DataFrame:
    """doc_id and the measures of each whole text; all 0 for a null or empty text."""
    n = F.col("n_words")
    out = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text"))
    out = out.withColumn("_words", words(F.col("_text")))
    out = out.withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    out = out.withColumn("n_words", F.size("_words").cast("long"))
    out = out.withColumn("_bits", F.ceil(F.log2(F.col("n_words") + 1)).cast("int"))
    out = out.withColumn("_mask", F.expr("shiftleft(1L, _bits) - 1L"))
    # a window's hash with its low bits replaced by its place, so that one sort brings equal windows together
    out = out.withColumn("_at", F.expr("""
        CASE WHEN n_words > 3 THEN sort_array(transform(sequence(0, cast(n_words - 3 AS int)),
          i -> shiftleft(xxhash64(_words[i], _words[i + 1], _words[i + 2]), _bits) | i))
        ELSE cast(array() AS array<bigint>) END"""))
    out = out.withColumn("_next", F.expr("""
        CASE WHEN n_words > 3 THEN filter(sequence(1, cast(n_words - 3 AS int)),
          k -> shiftrightunsigned(_at[k] ^ _at[k - 1], _bits) = 0) ELSE cast(array() AS array<int>) END"""))
    out = out.withColumn("_pairs", F.expr("""
        filter(transform(_next, k -> struct(cast(_at[k - 1] & _mask AS int) AS a, cast(_at[k] & _mask AS int) AS b)),
          x -> _words[x.a] = _words[x.b] AND _words[x.a + 1] = _words[x.b + 1] AND _words[x.a + 2] = _words[x.b + 2])"""))
    out = out.withColumn("_found", F.expr("sort_array(array_distinct(concat(_pairs.a, _pairs.b)))"))
    letters = F.regexp_replace("_text", r"\P{L}+", "")
    return out.select(
        "doc_id", n,
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        # each window covers three words, less what the next found window covers itself
        F.expr("""CASE WHEN size(_found) = 0 THEN 0L ELSE 3L + aggregate(
          zip_with(slice(_found, 1, size(_found) - 1), slice(_found, 2, size(_found)),
                   (a, b) -> least(b - a, 3)), 0L, (s, x) -> s + x) END""").alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.length(letters).cast("long").alias("n_letters"),
        F.length(F.regexp_replace("_text", r"\P{Lu}+", "")).cast("long").alias("n_upper"),
        F.length(F.regexp_replace("_text", r"[^.]+", "")).cast("long").alias("n_stops"),
        F.length(F.regexp_replace("_text", r"[^!]+", "")).cast("long").alias("n_marks"),
    )


def _posterior(state: dict[str, float], rules: tuple[Rule, ...]) -> Column:
    from math import log

    odds = F.lit(log(state["prior"] / (1 - state["prior"])))
    for r in rules:
        g, b = state[f"g_{r.name}"], state[f"b_{r.name}"]
        odds = odds + F.when(F.col(r.name), log(g / b)).otherwise(log((1 - g) / (1 - b)))
    return 1 / (1 + F.exp(-odds))


def estimate(patterns: DataFrame, rules: tuple[Rule, ...] = RULES, model: QualityModel = QualityModel()) -> dict[str, float]:
    """Prior of good and, for each rule, how often it votes on good (g) and on bad (b) documents; from
    these and the prior follows its ``accuracy``, the share of its votes that are right. ``patterns`` has
    one row a vote pattern and its count ``n``. An empty table returns smoothed values."""
    state = {"prior": model.prior}
    for r in rules:
        state[f"g_{r.name}"], state[f"b_{r.name}"] = (
            (model.seldom, model.often) if r.says == "bad" else (model.praise_good, model.praise_bad))
    keep = lambda x: min(max(x, model.low), model.high)
    for _ in range(model.rounds):
        rows = patterns.withColumn("q", _posterior(state, rules))
        good, bad = F.col("n") * F.col("q"), F.col("n") * (1 - F.col("q"))
        sums = [F.sum(good).alias("good"), F.sum(bad).alias("bad")]
        for r in rules:
            sums += [F.sum(F.when(F.col(r.name), good)).alias(f"g_{r.name}"), F.sum(F.when(F.col(r.name), bad)).alias(f"b_{r.name}")]
        got = {k: v or 0.0 for k, v in rows.agg(*sums).first().asDict().items()}
        state = {"prior": keep((got["good"] + 1) / (got["good"] + got["bad"] + 2))}
        for r in rules:
            for side, total in (("g", "good"), ("b", "bad")):
                state[f"{side}_{r.name}"] = keep((got[f"{side}_{r.name}"] + 1) / (got[total] + 2))
    return state


def accuracy(rule: Rule, state: dict[str, float]) -> float:
    """Share of a rule's votes that are right, under the estimated state."""
    good, bad = state["prior"] * state[f"g_{rule.name}"], (1 - state["prior"]) * state[f"b_{rule.name}"]
    return (good if rule.says == "good" else bad) / (good + bad)


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, model: QualityModel = QualityModel()) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text; other columns are not read): the measures, a boolean
    column a rule (it votes), ``posterior`` and ``good`` (posterior at or above the threshold).

    A null or empty text has measures of 0 and whatever its rules then say; repeated rows are judged
    alike; an empty table gives an empty result.
    """
    voted = cut(measures(docs).withColumns({r.name: F.coalesce(F.expr(r.where), F.lit(False)) for r in rules}))
    names = [r.name for r in rules]
    patterns = cut(voted.groupBy(*names).agg(F.count("*").alias("n")).coalesce(1))
    state = estimate(patterns, rules, model)
    return voted.withColumn("posterior", _posterior(state, rules)).withColumn("good", F.col("posterior") >= model.threshold)


def op1(docs: DataFrame) -> DataFrame:
    """The contract of the query: base measures, base_failed, kept."""
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return judge(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & F.col("good")).alias("kept"),
        *[r.name for r in RULES],
    )
