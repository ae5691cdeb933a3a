"""Phonetic keys: the primary key of Double Metaphone (Philips 2000) per word, joined by spaces.

The published rules are kept as an ordered table of (letters consumed in context, code). One
compiled alternation applies them left to right, so the first rule that fits at a position wins.
Words are lower-case ``[a-z0-9]+``. In the table ``V`` stands for any vowel.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .text import is_latin_script

# The published rule set. "-" rules are left out for words of Slavic or Germanic
# spelling, "*" rules apply only to words beginning with "sch", unmarked rules to all.
_RULES = """
    ^g(?=n)|^k(?=n)|^p(?=n)|^w(?=r)|^p(?=s)         =
    ^x                                              = S
    ^[V]                                            = A
    [V]                                             =
    bb?                                             = P
    (?<=[^V]a)ch(?=[^ie]|$)                         = K
    (?<=[bm]a)ch(?=er)                              = K
    ^ca(?=esar)                                     = S
    ch(?=ia)                                        = K
    (?<!^)ch(?=ae)                                  = K
    ^ch(?=arac|aris|or(?!e)|ym|ia|em)               = K
  * ch                                              = K
    (?<=or)ch(?=es|id)|(?<=ar)ch(?=it)|(?<=^s)ch    = K
    ch(?=[ts])                                      = K
    (?:^|(?<=[aoue]))ch(?=[lrnmbhfvw])              = K
    (?<=^m)ch                                       = K
    ch                                              = X
    (?<!wi)cz                                       = S
    c(?=cia)..                                      = X
    (?<=^a)cc(?=[ie]|h(?!u)).                       = KS
    (?<=u)cc(?=ee|es).                              = KS
    (?<!^m)cc(?=[ie]|h(?!u)).                       = X
    (?<!^m)cc                                       = K
    c[kgq]                                          = K
    c[iey]                                          = S
    c(?:[kq]|c(?![ei]))?                            = K
    dg[iey]                                         = J
    dg                                              = TK
    d[td]?                                          = T
    ff?                                             = F
    (?<=[^V])gh                                     = K
    ^gh(?=i)                                        = J
    ^gh                                             = K
    (?:(?<=[bhd].)|(?<=[bhd]..)|(?<=[bh]...))gh     =
    (?<=[cglrt].u)gh                                = F
    (?<=[^i])gh                                     = K
    gh                                              =
  - (?<=^[V])gn                                     = KN
  - gn(?!ey)                                        = N
    gn                                              = KN
  - g(?=li)l                                        = KL
    ^g(?:y|(?=es|ep|eb|el|ey|ib|il|in|ie|ei|er).)   = K
    (?<!^dan)(?<!^ran)(?<!^man)(?<![ei])g(?=er).    = K
    (?<!^dan)(?<!^ran)(?<!^man)(?<![eiro])gy        = K
  * g[eiy]|(?<=[ao])gg(?=i)                         = K
    g(?=et).                                        = K
    g[eiy]|(?<=[ao])gg(?=i)                         = J
    gg?                                             = K
    (?:^|(?<=[V]))h[V]                              = H
    h                                               =
    (?:j(?=ose)|^j)j?                               = J
    (?<=[V])j(?=[ao])                               = J
    (?<![skl])j(?![ltksnmbz])j?                     = J
    j$                                              = J
    jj?                                             =
    kk?                                             = K
    ll?                                             = L
    (?<=u)m(?=b$|ber).|mm?                          = M
    nn?                                             = N
    ph                                              = F
    p[pb]?                                          = P
    qq?                                             = K
  - (?<!meie)(?<!maie)(?<=ie)r$                     =
    rr?                                             = R
    (?<=i)s(?=l)|(?<=y)s(?=l)                       =
    ^s(?=ugar)                                      = X
    sh(?=eim|oek|olm|olz)                           = S
    sh                                              = X
    si[oa]                                          = S
    sz                                              = S
    ^s(?=[mnlw])                                    = S
    sch(?=er|en)                                    = X
    sch(?=oo|uy|ed|em)                              = SK
    sch                                             = X
    sc[iey]                                         = S
    sc.?                                            = SK
    (?<=ai)s$|(?<=oi)s$                             =
    ss?                                             = S
    tio(?=n)|tia|tch                                = X
    t(?:h|th)(?=om|am)                              = T
  * t(?:h|th)                                       = T
    t(?:h|th)                                       = 0
    t[td]?                                          = T
    vv?                                             = F
    wr                                              = R
    ^w(?=[Vh])                                      = A
  * w                                               =
    w(?:icz|itz)                                    = TS
    w                                               =
    (?<=iau)x$|(?<=eau)x$|(?<=au)x$|(?<=ou)x$       =
    x[cx]?                                          = KS
    zh                                              = J
    zz?                                             = S
    .                                               =
"""
_SLAVIC = re.compile("w|k|cz|witz")


def _compile(slavic: bool, sch: bool) -> tuple[re.Pattern, list[str]]:
    wanted = {"": True, "-": not slavic, "*": sch}
    patterns, codes = [], []
    for line in _RULES.strip().splitlines():
        rule, _, code = line.rpartition("=")  # codes never hold "=", so the last one ends the rule
        rule = rule.strip()
        mark = rule[0] if rule[:2] in ("- ", "* ") else ""
        if wanted[mark]:
            rule = rule[len(mark):].strip().replace("[V", "[aeiouy").replace("[^V", "[^aeiouy")
            patterns.append(f"({rule})")
            codes.append(code.strip())
    return re.compile("|".join(patterns)), codes


_VARIANTS = {(slavic, sch): _compile(slavic, sch) for slavic in (False, True) for sch in (False, True)}


@lru_cache(maxsize=1 << 17)
def word_key(word: str) -> str:
    rules, codes = _VARIANTS[bool(_SLAVIC.search(word)), word.startswith("sch")]
    return rules.sub(lambda m: codes[m.lastindex - 1], word)


@F.pandas_udf(StringType())
def _keys(normal: pd.Series) -> pd.Series:
    def key(text: str):
        return " ".join(filter(None, map(word_key, text.split()))) or None

    return normal.map(key, na_action="ignore")


def phonetic_code(title: Column, normal: Column) -> Column:
    """NULL unless the raw title is Latin script and some word yields a key. Map-only: a word's key
    is memoised per worker instead of shuffling every token (frequent words would pile up)."""
    return _keys(F.when(is_latin_script(title) & (normal != ""), normal))
