"""Personal data replaced by surrogates of the same kind.

Detected entities get keyed replacements: digits for digits, letters of the same alphabet and case, valid
check digits, names that keep gender and script. Entities that differ only in writing (case, separators)
share one surrogate in every document, and different ones never do: surrogates that meet each other or a
real entity are drawn again. Only DataFrame functions are used.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, seeded_rank

#: Titles that announce a name (fixed values).
MALE_TITLES = ("Mr", "Mister", "Herr", "Señor", "Monsieur")
FEMALE_TITLES = ("Mrs", "Ms", "Miss", "Frau", "Señora", "Señorita", "Madame", "Mme", "Mlle")
OTHER_TITLES = ("Dr", "Prof")

_TITLES = "|".join(sorted(MALE_TITLES + FEMALE_TITLES + OTHER_TITLES, key=lambda t: (-len(t), t)))
_SECRET_HEAD = r"""(?i:\b(?:token|secret|password|passwd|api[_-]?key|access[_-]?key|auth[_-]?key)\b["']?\s{0,3}[:=]\s{0,3}["']?)"""
#: A capitalised word with a lower-case letter, whole across hyphens, apostrophes and inner capitals.
_NAME = r"(?=[\p{L}\p{M}'’-]{1,60}\p{Ll})\p{Lu}[\p{L}\p{M}'’-]{0,60}[\p{L}\p{M}]"
_PATTERNS = {
    "secret": _SECRET_HEAD + r"""(?=[^\s"'<>]{0,200}\d)[^\s"'<>]{6,}""",
    "key": r"\b(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|sk-[A-Za-z0-9]{20,})\b",
    # classes of bounded length instead of repeated groups, which take the regex engine a stack frame a turn
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}+@(?=[A-Za-z0-9-]{1,190}\.[A-Za-z0-9-]{0,60}[A-Za-z0-9])(?:(?!\.\.)[A-Za-z0-9.-]){1,250}(?<=[A-Za-z0-9])",
    "iban": r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    "card": r"(?<![\w.+-])(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}|\d{4}([ -])\d{6}\2\d{5})(?![\w-])",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "phone": r"(?:(?<![\w+])(?:\+?1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}|(?<![\w+])\+1\d{10}"
             r"|(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]\d{2,4}){1,3})(?!\d)",
    "ip": r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?!\w|\.\d)",
    "name": r"(?<!\w)(?:" + _TITLES + r")\.? " + _NAME + r"(?: " + _NAME + r")?",
}
#: Any entity; the first kind that fits at a place wins.
PATTERN = "|".join(p for p in _PATTERNS.values())
_CHEAP = r"[@0-9]"  # every kind but names needs one of these
_NAMED = r"(?:" + _TITLES + r")\.? \p{Lu}"

_SYLLABLES = {
    "latin": "ba be bi bo da de di do fa fe fi ga ge gi ka ke ki ko la le li lo ma me mi mo na ne ni no ra re ri ro sa se si ta te ti to va ve".split(),
    "cyrillic": "ба бе би бо да де ди до га ге ка ко ла ле ли ло ма ме ми мо на не ни но ра ре ри ро са се си та те ти то ва ве ви зо ку лу".split(),
    "greek": "βα βε βι βο δα δε δι δο γα γε κα κο λα λε λι λο μα με μι μο να νε νι νο ρα ρε ρι ρο σα σε σι τα τε τι το".split(),
}
_ENDINGS = {
    ("given_male", "latin"): "n", ("given_male", "cyrillic"): "н", ("given_male", "greek"): "ς",
    ("given_female", "latin"): "na", ("given_female", "cyrillic"): "на", ("given_female", "greek"): "να",
    ("given_other", "latin"): "l", ("given_other", "cyrillic"): "л", ("given_other", "greek"): "λ",
    ("surname", "latin"): "rt", ("surname", "cyrillic"): "рт", ("surname", "greek"): "ρη",
}
_ALPHABETS = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "абвгдежзиклмнопрстуфхцчшщэюя", "αβγδεζηθικλμνξοπρστυφχψω")


@dataclass(frozen=True)
class Surrogates:
    key: str = "replace this key"  # keep it secret; the same key gives the same surrogates
    rounds: int = 10  # draws after which entities of small formats get unused codes by rank


def _quote(s: str) -> str:
    return "r'" + s.replace("'", r"\x27") + "'"


def _byte(h: str, i: str) -> str:
    """SQL for the i-th byte (from 0, wrapping) of a 128-digit hex hash."""
    return f"cast(conv(substr({h}, cast(2 * (({i}) % 64) + 1 AS int), 2), 16, 10) AS int)"


def _masked(x: str, h: str, keep: int = 0) -> str:
    """SQL: each digit and letter of ``x`` after the first ``keep`` characters drawn anew from its own alphabet."""
    b = _byte(h, "i + length(x)")
    cases = f"WHEN i <= {keep} THEN substr(x, i, 1) WHEN substr(x, i, 1) RLIKE '[0-9]' THEN cast({b} % 10 AS string)"
    for letters in _ALPHABETS:
        cases += f" WHEN instr('{letters}', substr(x, i, 1)) > 0 THEN substr('{letters}', {b} % {len(letters)} + 1, 1)"
    cases += f" WHEN substr(x, i, 1) RLIKE '\\\\p{{L}}' THEN substr('{_ALPHABETS[0]}', {b} % 26 + 1, 1)"
    return f"element_at(transform(array({x}), x -> array_join(transform(sequence(1, length(x)), i -> CASE {cases} ELSE substr(x, i, 1) END), '')), 1)"


def _hex(x: str, h: str) -> str:
    return f"array_join(transform(sequence(1, length({x})), i -> CASE WHEN substr({x}, i, 1) RLIKE '[0-9a-f]' THEN substr('0123456789abcdef', {_byte(h, 'i')} % 16 + 1, 1) ELSE substr({x}, i, 1) END), '')"


def _luhn(digits: str) -> str:
    """SQL: sum of the digits with every second one from the right doubled."""
    d = f"cast(substr({digits}, i, 1) AS int)"
    twice = f"(length({digits}) - i) % 2 = 1"
    return f"aggregate(sequence(1, length({digits})), 0, (s, i) -> s + CASE WHEN {twice} THEN CASE WHEN {d} > 4 THEN 2 * {d} - 9 ELSE 2 * {d} END ELSE {d} END)"


def _mod97(iban: str) -> str:
    """SQL: the remainder that a valid number has 1 for."""
    turned = f"concat(substr({iban}, 5), substr({iban}, 1, 4))"
    c = "substr(t, i, 1)"
    return (f"element_at(transform(array({turned}), t -> aggregate(sequence(1, length(t)), 0, (s, i) -> CASE WHEN {c} RLIKE '[0-9]' "
            f"THEN (s * 10 + cast({c} AS int)) % 97 ELSE (s * 100 + ascii({c}) - 55) % 97 END)), 1)")


def _syllables(kind: str, h: str) -> str:
    def word(script: str) -> str:
        s = _SYLLABLES[script]
        pick = f"element_at(array({', '.join(repr(x) for x in s)}), {_byte(h, 'i')} % {len(s)} + 1)"
        return f"concat(initcap(array_join(transform(sequence(1, 3 + attempt), i -> {pick}), '')), '{_ENDINGS[kind, script]}')"

    return f"CASE WHEN canon RLIKE '\\\\p{{IsCyrillic}}' THEN {word('cyrillic')} WHEN canon RLIKE '\\\\p{{IsGreek}}' THEN {word('greek')} ELSE {word('latin')} END"


def entities(text: Column) -> Column:
    """Detected entities of a text in order, as written; none for a null."""
    found = F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))
    return F.when(text.rlike(_CHEAP) | text.rlike(_NAMED), found).otherwise(F.array().cast("array<string>"))


def parsed(raw: DataFrame) -> DataFrame:
    """raw (as written), ``head`` (what stays before it) and ``parts``: array of (kind, canon, written).
    What turns out not to be an entity (wrong check digit, octet above 255) has no row."""
    fits = lambda k: F.col("raw").rlike("^(?:" + _PATTERNS[k] + ")$")
    kind = F.coalesce(*[F.when(fits(k), F.lit(k)) for k in _PATTERNS])
    out = raw.select("raw", kind.alias("kind"))
    title = F.regexp_extract("raw", rf"^((?:{_TITLES})\.? )", 1)
    head = F.when(F.col("kind") == "secret", F.regexp_extract("raw", "^" + _SECRET_HEAD.replace("(?i:", "((?i:", 1) + ")", 1)).when(F.col("kind") == "name", title).otherwise(F.lit(""))
    out = out.withColumn("head", head).withColumn("body", F.expr("substr(raw, length(head) + 1)"))
    out = out.withColumn("plain", F.regexp_replace("body", r"[ ().-]", ""))
    good = F.expr(f"""CASE kind WHEN 'card' THEN {_luhn('plain')} % 10 = 0 WHEN 'iban' THEN {_mod97('plain')} = 1
        WHEN 'ip' THEN forall(split(body, '[.]'), o -> cast(o AS int) < 256) ELSE true END""")
    canon = F.when(F.col("kind").isin("card", "iban", "ssn", "phone"), F.col("plain")).when(F.col("kind") == "email", F.lower("body")).otherwise(F.col("body"))
    bare = F.regexp_replace("head", r"[. ]", "")
    gender = F.when(bare.isin(*MALE_TITLES), "given_male").when(bare.isin(*FEMALE_TITLES), "given_female").otherwise("given_other")
    words = F.split("body", " ")
    part = lambda k, c, w: F.struct(k.alias("kind"), F.lower(c).alias("canon"), w.alias("written"))
    name = F.when(F.size(words) == 2, F.array(part(gender, words[0], words[0]), part(F.lit("surname"), F.element_at(words, -1), F.element_at(words, -1)))).otherwise(
        F.array(part(F.lit("surname"), words[0], words[0])))
    one = F.array(F.struct(F.col("kind"), canon.alias("canon"), F.col("body").alias("written")))
    return out.filter(good).select("raw", "head", F.when(F.col("kind") == "name", name).otherwise(one).alias("parts"))


_LONG = 512  # e-mail addresses and whatever has a format are shorter

_TLD = "substring_index(canon, '.', -1)"
_LABELS = f"substr(canon, 1, length(canon) - length({_TLD}))"


def _draw(pending: DataFrame, cfg: Surrogates) -> DataFrame:
    """``pending`` (kind, canon, attempt and, of e-mail addresses, ``host``: the surrogate of the domain) with a surrogate."""
    key = cfg.key
    rows = pending.withColumn("h", F.sha2(F.concat_ws("|", F.lit(key), "kind", "attempt", "canon").cast("binary"), 512))
    octet = lambda i: f"cast({_byte('h', str(i))} % 254 + 1 AS string)"
    local = "substring_index(canon, '@', 1)"
    card = _masked("substr(canon, 1, length(canon) - 1)", "h", keep=1)
    phone = f"CASE WHEN substr(canon, 1, 1) = '+' THEN {_masked('canon', 'h', keep=2)} ELSE {_masked('canon', 'h')} END"
    iban = f"concat(substr(canon, 1, 2), '00', {_masked('substr(canon, 5)', 'h')})"
    rows = rows.withColumn("base", F.expr(f"CASE kind WHEN 'card' THEN {card} WHEN 'iban' THEN {iban} END"))
    checked = {
        "card": f"concat(base, cast((10 - {_luhn('concat(base, 0)')} % 10) % 10 AS string))",
        "iban": f"concat(substr(base, 1, 2), lpad(cast(98 - {_mod97('base')} AS string), 2, '0'), substr(base, 5))",
        "ip": f"concat_ws('.', {', '.join(map(octet, range(4)))})",
        "email": f"concat({_masked(local, 'h')}, '@', host)",
        "domain": f"concat({_masked(_LABELS, 'h')}, {_TLD})",
        "secret": f"CASE WHEN canon RLIKE '^[0-9a-f]+$' THEN {_hex('canon', 'h')} ELSE {_masked('canon', 'h')} END",
        "key": _masked("canon", "h", keep=4), "ssn": _masked("canon", "h"), "phone": phone,
    } | {k: _syllables(k, "h") for k in ("given_male", "given_female", "given_other", "surname")}
    cases = " ".join(f"WHEN '{k}' THEN {v}" for k, v in checked.items())
    # place by place a text of n characters takes n * n steps; long secrets get their hash over and over
    long = "substr(repeat(h, cast(length(canon) div 128 + 1 AS int)), 1, length(canon))"
    return rows.withColumn("surrogate", F.expr(f"CASE WHEN length(canon) > {_LONG} THEN {long} ELSE CASE kind {cases} END END")).drop("h", "base")


def _meets(rows: DataFrame, others: DataFrame, column: str, how: str) -> DataFrame:
    """``rows`` whose surrogate is (left_semi) or is not (left_anti) in ``column`` of ``others``, by kind and case-blind."""
    seen = others.select(F.col("kind").alias("k"), F.lower(column).alias("v")).distinct()
    return rows.join(seen, (F.col("kind") == F.col("k")) & (F.lower("surrogate") == F.col("v")), how)


_DIGITS = "0123456789"
_LARGE = 1e15  # a format of more codes cannot be used up; its entities are drawn again


def _letters(x: str, keep: str = "0") -> str:
    """SQL: for each character of ``x`` those that ``_masked`` may put there."""
    cases = f"WHEN i <= {keep} THEN substr({x}, i, 1) WHEN substr({x}, i, 1) RLIKE '[0-9]' THEN '{_DIGITS}'"
    for letters in _ALPHABETS:
        cases += f" WHEN instr('{letters}', substr({x}, i, 1)) > 0 THEN '{letters}'"
    cases += f" WHEN substr({x}, i, 1) RLIKE '\\\\p{{L}}' THEN '{_ALPHABETS[0]}'"
    return f"transform(sequence(1, length({x})), i -> CASE {cases} ELSE substr({x}, i, 1) END)"


def _formats(pending: DataFrame, cfg: Surrogates) -> DataFrame:
    """``pending`` with ``letters`` (choices a place), ``tail`` (what follows, the domain of an e-mail address), ``space`` (number
    of codes) and ``format`` (a digest, case-blind). Letters are null for kinds with check digits, addresses and names."""
    hexes = f"transform(sequence(1, length(canon)), i -> '{_DIGITS}abcdef')"
    letters = f"""CASE WHEN kind = 'email' THEN {_letters("substring_index(canon, '@', 1)")} WHEN kind = 'ssn' THEN {_letters('canon')}
        WHEN kind = 'phone' THEN {_letters('canon', "(CASE WHEN substr(canon, 1, 1) = '+' THEN 2 ELSE 0 END)")}
        WHEN kind = 'domain' THEN concat(array_repeat('{_DIGITS}', extra), {_letters(_LABELS)}, transform(sequence(1, length({_TLD})), i -> substr({_TLD}, i, 1)))
        WHEN kind = 'secret' AND canon RLIKE '^[0-9a-f]+$' THEN {hexes} WHEN kind = 'secret' THEN {_letters('canon')} END"""
    rows = _draw(pending, cfg).withColumn("tail", F.expr("CASE WHEN kind = 'email' THEN lower(concat('@', substring_index(surrogate, '@', -1))) ELSE '' END"))
    rows = rows.withColumn("letters", F.expr(f"concat({letters}, array_repeat('{_DIGITS}', CASE WHEN kind = 'domain' THEN 0 ELSE extra END))"))
    rows = rows.withColumn("space", F.expr("aggregate(letters, 1D, (s, x) -> s * length(x))"))
    return rows.withColumn("format", F.md5(F.concat_ws("|", "kind", "tail", F.lower(F.to_json("letters")))))


def _ranked(pending: DataFrame, taken: DataFrame, cfg: Surrogates) -> DataFrame:
    """``pending`` with surrogates that are in no row of ``taken`` (kind, v in lower case). Entities and free codes of a format
    are both ranked by keyed hash and joined by rank; an entity beyond the last free code gets a null. So many codes of a
    format are listed as it has entities and taken values of its length at most, so enough of them are free if there are enough."""
    rows = cut(_formats(pending, cfg))
    small = rows.filter(F.col("space") <= _LARGE)
    tail = F.expr("CASE WHEN kind = 'email' THEN concat('@', substring_index(v, '@', -1)) ELSE '' END")
    known = taken.groupBy("kind", tail.alias("tail"), F.length("v").alias("size")).agg(F.count("*").alias("m"))
    groups = small.groupBy("format", "kind", "tail").agg(F.first(F.expr("transform(letters, x -> lower(x))")).alias("choices"), F.first("space").cast("long").alias("space"), F.count("*").alias("n"))
    groups = groups.withColumn("size", F.expr("size(choices) + length(tail)")).join(known, ["kind", "tail", "size"], "left")
    groups = groups.withColumn("k", F.least("space", F.expr("n + coalesce(m, 0)")))
    start = F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(cfg.key), "format"), 256), 1, 12), 16, 10).cast("long") % F.col("space")
    codes = groups.withColumn("start", start).withColumn("c", F.expr("explode(sequence(0L, (k - 1) div 10000))"))
    codes = codes.withColumn("j", F.expr("explode(sequence(c * 10000, least(k, (c + 1) * 10000) - 1))")).withColumn("j", F.expr("(start + j) % space"))
    code = F.expr("""aggregate(reverse(choices), struct(j AS j, '' AS out), (s, x) -> struct(s.j div length(x) AS j,
        concat(substr(x, cast(s.j % length(x) AS int) + 1, 1), s.out) AS out), s -> s.out)""")
    codes = codes.select("kind", "format", code.alias("code"), F.concat(code, "tail").alias("v"))
    free = codes.join(taken.select("kind", "v"), ["kind", "v"], "left_anti").select("format", "code")
    keyed = lambda c: F.sha2(F.concat_ws("|", F.lit(cfg.key), c), 256)
    free = cut(seeded_rank(free, ["format"], [keyed("code"), F.col("code")], "turn"))
    asked = seeded_rank(small, ["format"], [keyed("canon"), F.col("canon")], "turn").drop("surrogate")
    filled = F.expr(f"""concat(array_join(transform(letters, (x, i) -> CASE WHEN length(x) = 1 THEN x WHEN x = '{_ALPHABETS[1]}'
        THEN upper(substr(code, i + 1, 1)) ELSE substr(code, i + 1, 1) END), ''), tail)""")
    dealt = asked.join(free, ["format", "turn"], "left").withColumn("surrogate", F.when(F.col("code").isNotNull(), filled))
    columns = [*pending.columns, "surrogate"]
    return dealt.select(columns).unionByName(rows.filter(F.col("space").isNull() | (F.col("space") > _LARGE)).select(columns))


def assign(found: DataFrame, cfg: Surrogates = Surrogates()) -> DataFrame:
    """(kind, canon, surrogate) for the distinct (kind, canon) of ``found``: no two of a kind share a
    surrogate and none is a real entity of ``found``. Where a format has fewer codes than that takes, the
    surrogates of some entities are a digit longer. Domains of e-mail addresses are entities of their own: equal
    ones get equal surrogates, different ones different ones."""
    real = cut(found.select("kind", "canon").distinct())
    domain = F.when(F.col("kind") == "email", F.substring_index("canon", "@", -1))
    domains = real.select(F.lit("domain").alias("kind"), domain.alias("canon")).filter("canon IS NOT NULL").distinct()
    pending = real.withColumns({"attempt": F.lit(0), "extra": F.lit(0), "host": F.lit(None).cast("string")})
    if not domains.isEmpty():
        hosts = cut(assign(domains, cfg)).select(F.col("canon").alias("was"), F.col("surrogate").alias("now"))
        pending = cut(pending.withColumn("was", domain).join(hosts, "was", "left").withColumn("host", F.col("now")).drop("was", "now"))
    done, turns = None, 0
    while True:
        if turns < cfg.rounds:
            drawn = _draw(pending, cfg)
        else:
            taken = real.select("kind", F.lower("canon").alias("v"))
            if done is not None:
                taken = taken.unionByName(done.select("kind", F.lower("surrogate").alias("v")))
            drawn = cut(_ranked(pending, cut(taken.distinct()), cfg))
            short = drawn.filter("surrogate IS NULL").select("kind", "canon", F.lit(1).alias("short"))
            pending = cut(pending.join(short, ["kind", "canon"], "left").withColumn("extra", F.col("extra") + F.coalesce("short", F.lit(0))).drop("short"))
            drawn = drawn.filter("surrogate IS NOT NULL")
        turns += 1
        order = Window.partitionBy("kind", F.lower("surrogate")).orderBy("canon")
        drawn = drawn.withColumn("turn", F.row_number().over(order))
        free = _meets(drawn.filter("turn = 1"), real, "canon", "left_anti")
        if done is not None:
            free = _meets(free, done, "surrogate", "left_anti")
        taken = cut(free.select("kind", "canon", "surrogate"))
        rest = cut(pending.join(taken, ["kind", "canon"], "left_anti").withColumn("attempt", F.col("attempt") + 1))
        done = taken if done is None else done.unionByName(taken)
        if rest.isEmpty():
            return done
        pending = rest


def _settled(parts: DataFrame) -> DataFrame:
    """``parts`` with one kind for each given name: the gender that its titles agree on, else neither."""
    given = parts.filter(F.col("kind").startswith("given_")).groupBy("canon").agg(
        F.bool_or(F.col("kind") == "given_male").alias("male"), F.bool_or(F.col("kind") == "given_female").alias("female"))
    kind = F.when(F.col("male") & ~F.col("female"), "given_male").when(F.col("female") & ~F.col("male"), "given_female").otherwise("given_other")
    given = given.select(F.col("canon").alias("_name"), kind.alias("_kind"))
    joined = parts.join(given, F.col("kind").startswith("given_") & (F.col("canon") == F.col("_name")), "left")
    return joined.withColumn("kind", F.coalesce("_kind", "kind")).drop("_name", "_kind")


def replacements(raw: DataFrame, cfg: Surrogates = Surrogates()) -> DataFrame:
    """(raw, new, names) for distinct entities as written; ``names`` has each word of a name with its surrogate.
    Digits and letters of a surrogate fill the places that the entity has for them, so separators stay; capital
    spelling stays with e-mail addresses."""
    read = cut(parsed(raw))
    parts = cut(_settled(read.select("raw", "head", F.posexplode("parts").alias("at", "part")).select("raw", "head", "at", "part.*")))
    joined = parts.join(assign(parts, cfg), ["kind", "canon"])
    filled = F.expr(r"""aggregate(sequence(1, length(written)), struct('' AS out, 1 AS n), (s, i) ->
        CASE WHEN substr(written, i, 1) RLIKE '[^ ().-]' THEN struct(concat(s.out, substr(surrogate, s.n, 1)) AS out, s.n + 1 AS n)
        ELSE struct(concat(s.out, substr(written, i, 1)) AS out, s.n AS n) END, s -> concat(s.out, substr(surrogate, s.n)))""")
    shape = F.when(F.col("kind").isin("card", "iban", "ssn", "phone"), filled).when(
        (F.col("kind") == "email") & (F.col("written") == F.upper("written")), F.upper("surrogate")).otherwise(F.col("surrogate"))
    word = F.when(F.col("kind").startswith("given_") | (F.col("kind") == "surname"), F.struct(F.col("written").alias("real"), F.col("surrogate").alias("alias")))
    new = joined.select("raw", "head", F.struct("at", shape.alias("text")).alias("p"), word.alias("w")).groupBy("raw", "head").agg(
        F.array_sort(F.collect_list("p")).alias("ps"), F.collect_list("w").alias("names"))
    return new.select("raw", F.concat("head", F.array_join(F.col("ps.text"), " ")).alias("new"), "names")


def pseudonymised(docs: DataFrame, cfg: Surrogates = Surrogates()) -> DataFrame:
    """``docs`` with surrogates in ``text``, ``n_replaced`` added and, where there is one, ``n_chars`` brought up
    to date; all other columns pass through (names that begin with ``_pii_`` are reserved).

    ``n_replaced`` counts entities; names of a document that recur in it without a title are replaced but not
    counted. Null and empty texts, and texts without an entity, stay as they are with n_replaced 0; repeated rows
    change alike; an empty table gives an empty result. Texts without an entity are never shuffled; equal
    texts are read for entities once.
    """
    docs = docs.drop("n_replaced")
    found = F.coalesce(entities(F.col("text")), F.array().cast("array<string>"))
    marked = docs.withColumn("_pii_found", found)
    with_any = marked.filter(F.size("_pii_found") > 0).withColumn("_pii_text", F.md5(F.col("text").cast("binary")))
    lists = cut(with_any.select("_pii_text", "_pii_found").dropDuplicates(["_pii_text"]))
    spread = lists.select("_pii_text", F.posexplode("_pii_found").alias("at", "raw"))
    new = cut(replacements(spread.select("raw").distinct(), cfg))
    told = spread.join(new, "raw", "left").select("_pii_text", F.struct("at", F.coalesce("new", "raw").alias("new"), F.col("new").isNotNull().alias("hit")).alias("e"), "names")
    told = told.groupBy("_pii_text").agg(
        F.array_sort(F.collect_list("e")).alias("_pii_new"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("names")))).alias("_pii_names"))
    changed = with_any.join(told, "_pii_text")
    # what lies between entities; names of the document that recur there without a title get their surrogates too
    again = lambda t, n: F.regexp_replace(t, F.concat(F.lit(r"(?<![\p{L}\p{M}'’-])"), n["real"], F.lit(r"(?![\p{L}\p{M}])")), n["alias"])
    between = F.split("text", PATTERN, -1)
    between = F.when(F.size("_pii_names") > 0, F.transform(between, lambda t: F.aggregate("_pii_names", t, again))).otherwise(between)
    text = F.concat(between[0], F.array_join(F.zip_with(F.col("_pii_new.new"), F.slice(between, 2, F.size("_pii_new")), lambda a, b: F.concat(a, b)), ""))
    count = F.size(F.filter(F.col("_pii_new.hit"), lambda x: x)).cast("long")
    changed = changed.withColumn("n_replaced", count).withColumn("text", text)
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    same = docs.filter(F.size(found) == 0).withColumn("n_replaced", F.lit(0).cast("long"))
    return same.unionByName(changed.select(*docs.columns, "n_replaced"))


def op8(docs: DataFrame) -> DataFrame:
    return pseudonymised(docs.select("doc_id", "text")).select("doc_id", "text", "n_replaced")
