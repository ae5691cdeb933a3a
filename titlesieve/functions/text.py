"""Column expressions over raw text: trimming, normal forms, scripts, embedding text."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Unicode white space plus the four ASCII separators that count as blank as well.
_BLANK = r"[\s\x1c-\x1f]"
_STRIP = rf"(?U)^{_BLANK}+|{_BLANK}+$"


def strip(c: Column) -> Column:
    """Trim every kind of white space, not only U+0020."""
    return F.regexp_replace(c, _STRIP, "")


def is_blank(c: Column) -> Column:
    """NULL, empty or only white space."""
    return F.coalesce(strip(c) == "", F.lit(True))


def is_blank_or_nan(c: Column) -> Column:
    return F.coalesce(F.lower(strip(c)).isin("", "nan"), F.lit(True))


def blank_to_null(c: Column) -> Column:
    return F.when(~is_blank_or_nan(c), strip(c))


@F.pandas_udf(StringType())
def _compat_fold(s: pd.Series) -> pd.Series:
    return s.map(lambda t: unicodedata.normalize("NFKC", t).casefold(), na_action="ignore")


def fold(c: Column) -> Column:
    """Compatibility-compose and case-fold. Pure ASCII text never carries data into Python:
    the kernel's input is nulled for it and the JVM-side ``lower`` is used."""
    foreign = F.when(c.rlike(r"[^\x00-\x7F]"), c)
    return F.coalesce(_compat_fold(foreign), F.lower(c))


def normalize_title(c: Column) -> Column:
    return F.coalesce(F.trim(F.regexp_replace(fold(c), "[^a-z0-9]+", " ")), F.lit(""))


def normalize_domain(c: Column) -> Column:
    hyphens = F.regexp_replace(F.lower(strip(c)), rf"(?U){_BLANK}*-{_BLANK}*", "-")
    return F.when(c.isNull() | (c == ""), F.lit("unknown")).otherwise(
        F.regexp_replace(hyphens, rf"(?U){_BLANK}+", "-")
    )


def is_latin_script(c: Column) -> Column:
    """At least four fifths of the letters are Latin; text without letters counts as Latin."""
    letters = F.length(F.regexp_replace(c, r"[^\p{L}]", ""))
    latin = F.length(F.regexp_replace(F.regexp_replace(c, r"[^\p{L}]", ""), r"[^\p{IsLatin}]", ""))
    return (
        F.when(c.isNull() | (c == ""), F.lit(False))
        .when(letters == 0, F.lit(True))
        .otherwise(F.try_divide(latin, letters) >= 0.8)
    )


def embedding_text(title: Column, description: Column) -> Column:
    return F.when(~is_blank(description), F.concat(title, F.lit(". "), strip(description))).otherwise(title)


def tokens(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda t: t != "")


def token_set(c: Column) -> Column:
    return F.array_sort(F.array_distinct(tokens(c)))


def token_sort(c: Column) -> Column:
    return F.array_join(F.array_sort(tokens(c)), " ")


def verification_id(key: Column) -> Column:
    """Deterministic, so a retried task writes the same identifier."""
    return F.concat(F.lit("VR-"), F.upper(F.substring(F.sha2(key.cast("string"), 256), 1, 8)))


def clamp(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def round_exact(c: Column, digits: int) -> Column:
    """Round the exact binary value, ties to even (``round`` rounds the printed decimal, half up)."""
    text = F.regexp_replace(F.format_number(c, digits), ",", "")
    return text.cast("double")
