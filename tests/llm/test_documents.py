"""Operators on documents against brute force and on awkward rows."""

import hashlib
import re
import struct
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from titlesieve.llm import bpe, components, langid, mixing, neardup, pii, quality, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


# ------------------------------------------------------------------ quality

def measured(text):
    w = words(text)
    times = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    covered = {i + j for i in range(len(w) - 2) if times[tuple(w[i:i + 3])] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered))


def test_quality_measures(docs, awkward):
    texts = ["a b c a b c", "a a a a a", "a b c d a b c\na b c\n\na b c", "one two", "x y z x y", "# * | <> plain", "a b c"]
    rows = docs([(i, t, "en", "s") for i, t in enumerate(texts)])
    for table in (rows, awkward):
        got = quality.op1(table).select("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()
        want = [measured(r["text"]) for r in table.collect()]
        assert sorted(map(tuple, got)) == sorted(want)


def test_quality_separates_what_rules_disagree_on(docs):
    good = [(i, f"This is line {i} of plain prose with words{i} in it. It ends here{i}. " * 1 + " ".join(f"w{i}x{j}." if j % 9 == 0 else f"w{i}x{j}" for j in range(60)), "en", "s") for i in range(60)]
    bad = [(100 + i, " ".join(f"w{i}y{j}***" for j in range(70)), "en", "s") for i in range(8)]
    kept = {r["doc_id"]: r["kept"] for r in quality.op1(docs(good + bad)).collect()}
    assert all(kept[i] for i in range(60)) and not any(kept[100 + i] for i in range(8))


def test_quality_empty(docs):
    assert quality.op1(docs([])).count() == 0


# ------------------------------------------------------------------ language

def test_language(docs, awkward):
    en, de = "the of and to in that was for with this ", "der die und das nicht mit sich auf ein werden "
    rows = [(i, (en if i % 2 else de) * 4 + f"item {i}", "en" if i % 2 else "de", "s") for i in range(80)]
    got = {r["doc_id"]: r for r in langid.op2(docs(rows)).collect()}
    assert all(got[i]["lang_pred"] == ("en" if i % 2 else "de") for i in range(80))
    assert {r["held_out"] for r in got.values()} == {True, False}
    told = langid.op2(awkward).collect()
    assert len(told) == awkward.count()
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in told if r["doc_id"] in (1, 2, 3, 7))
    assert all(0 <= r["score"] <= 1 for r in told)
    assert langid.op2(docs([])).count() == 0
    unlabelled = langid.op2(docs([(1, "some text", None, "s")])).first()
    assert unlabelled["lang_pred"] == "und"


# ------------------------------------------------------------------ mixing

def shares(sizes, weights=(5, 2, 1)):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w, left, open_, out = {s: weights[i % 3] for i, s in enumerate(names)}, sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(w[s] for s in open_)
        over = {s for s in open_ if w[s] * level > 3 * sizes[s]}
        if not over:
            return out | {s: w[s] * level for s in open_}
        for s in over:
            out[s] = 3.0 * sizes[s]
            left -= out[s]
        open_ -= over
    return out


def test_mix(docs, awkward):
    rows = [(i, " ".join(["w"] * (1 + i * 7 % 90)), "en", [None, "a", "b", "c", "d", "é"][i * i % 6]) for i in range(400)]
    rows += [(900, "only one here", "en", "tiny")] + rows[:20]
    table = docs(rows)
    got = mixing.op3(table).collect()
    sizes = defaultdict(int)
    for _, t, _, s in rows:
        sizes[s] += len(words(t))
    want, taken = shares(sizes), defaultdict(int)
    source = {(i, len(words(t))): s for i, t, _, s in rows}
    assert len(got) == len(rows)
    for r in got:
        s = source[r["doc_id"], r["size"]]
        taken[s] += r["taken"]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s])
        assert r["taken"] % r["size"] == 0 and r["taken"] <= 3 * r["size"]
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.op3(table.repartition(7)).collect()))
    assert mixing.op3(awkward).count() == awkward.count()
    assert mixing.op3(docs([])).count() == 0 and mixing.mixture(docs([])).count() == 0
    mixed = mixing.mixture(table.filter("doc_id >= 20"))
    assert mixed.columns == table.columns
    plain = mixing.op3(table.filter("doc_id >= 20")).agg(F.sum("taken")).first()[0]
    assert sum(len(words(r["text"])) for r in mixed.collect()) == plain


def test_subset_sum_is_best():
    from itertools import product
    from random import Random

    r = Random(4)
    for _ in range(200):
        items = list({r.randrange(1, 12): r.randrange(1, 4) for _ in range(4)}.items())
        budget = r.randrange(0, 30)
        best = max(s for c in product(*[range(k + 1) for _, k in items]) if (s := sum(a * b for (a, _), b in zip(items, c))) <= budget)
        taken = mixing.subset_sum(items, budget)
        assert sum(n * k for n, k in taken.items()) == best and all(k <= dict(items)[n] for n, k in taken.items())


# ------------------------------------------------------------------ byte-level BPE

def test_bpe_equals_library(docs, awkward):
    import base64

    import public_tokenizers as public
    import tiktoken

    path = public.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    odd = docs([(i, t, "en", "s") for i, t in enumerate([
        "a" * 3000, "ab" * 2000, "  two  spaces \n\n x\x1c\x1f  y", "naïve ſtraße 漢字 😀😀 <|endoftext|>", "don't we'll 123456 ...!!!", "\U00010330\U00010331 x"])])
    for table in (odd, awkward):
        got = bpe.op4(table, path, public.PATTERN)
        want = []
        for r in table.collect():
            ids = library.encode_ordinary(r["text"] or "")
            packed = struct.pack(f"<{len(ids)}I", *ids)
            want.append((r["doc_id"], len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()))
        assert Counter(map(tuple, got.collect())) == Counter(want)
    assert bpe.op4(docs([]), path, public.PATTERN).count() == 0


# ------------------------------------------------------------------ near duplicates

def linked(rows, size=4):
    sets = []
    for _, text in rows:
        w = [re.sub("[A-Z]", lambda m: m.group().lower(), x) for x in words(text)]
        sets.append(frozenset(tuple(w[i:i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else []))
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    ids = {g: min((rows[i][0] for i in range(len(rows)) if group[i] == g and rows[i][0] is not None), default=None) for g in set(group)}
    return [(rows[i][0], len(sets[i]), ids[group[i]]) for i in range(len(rows))]


def test_near_duplicates(docs, awkward):
    from random import Random

    r = Random(9)
    rows = []
    for family in range(12):
        base = [f"w{family}x{r.randrange(400)}" for _ in range(r.choice([3, 12, 60, 150]))]
        for copy in range(r.choice([1, 2, 9, 25])):
            text = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 5])):
                text[r.randrange(len(text))] = f"new{r.randrange(10**6)}"
            rows.append((r.randrange(10**6), (" " if copy % 2 else "\n ").join(text).upper() if copy % 3 == 0 else " ".join(text)))
    shared = " ".join(f"passage{i}" for i in range(60))
    rows += [(2_000_000 + i, shared + " " + " ".join(f"own{i}y{j}" for j in range(40))) for i in range(30)]
    table = docs([(i, t, "en", "s") for i, t in rows])
    cfg = neardup.NearDup(words=4)
    got = neardup.near_duplicates(table, cfg).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert Counter(tuple(g)[:3] for g in got) == Counter(linked(rows))
    assert all(g["kept"] == (g["doc_id"] == g["component_id"]) for g in got)
    alone = [(x["doc_id"], x["text"]) for x in awkward.collect()]
    got = neardup.near_duplicates(awkward, cfg).collect()
    want = [(i, n, c if n else i) for i, n, c in linked(alone)]
    assert Counter(tuple(g)[:3] for g in got) == Counter(want)
    assert neardup.near_duplicates(docs([]), cfg).count() == 0
    stays = neardup.deduplicated(awkward)
    assert stays.columns == awkward.columns
    assert Counter(x["doc_id"] for x in stays.collect()) == Counter([1, 2, 3, 4, None, 7, 8, None, 9])
    assert neardup.deduplicated(table, cfg).count() == len({c for _, _, c in linked(rows)})


def test_components_of_paths_hubs_and_loops(spark):
    path = [(i, i + 1) for i in range(300)]
    hub = [(1000, 1000 + i) for i in range(1, 400)]
    edges = spark.createDataFrame(path + hub + [(7, 7), (5000, 5001), (5001, 5000)], "a long, b long")
    roots = {r["node"]: r["root"] for r in components.components(edges).collect()}
    assert len({roots[i] for i in range(301)}) == 1 and len({roots[1000 + i] for i in range(400)}) == 1
    assert len(set(roots.values())) == 3 and len(roots) == 301 + 400 + 2
    assert components.components(edges.limit(0)).count() == 0


# ------------------------------------------------------------------ personal data

EXAMPLES = [
    (1, "Mail BOB.x@Mail5.Example.com or bob.x@mail5.example.com, jim@mail5.example.com!"),
    (2, "+1 (706) 555-3138 or +1 706 555 3138; card 4041894974608795 and 4041-8949-7460-8795 not 4041894974608796."),
    (3, 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"### ip 152.143.123.131### v 999.1.1.1 ssn 123-45-6789'),
    (4, "Mr. John Smith met Frau Smith and Dr John Smith. Mr Иван Петров, IBAN DE89 3704 0044 0532 0130 00."),
    (5, "Version 2.0 of 13 lines, 4,000 words; password: none at all."),
]


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def test_surrogates(docs, awkward):
    table = docs([(i, t, "en", "s") for i, t in EXAMPLES])
    out = {r["doc_id"]: r for r in pii.pseudonymised(table).collect()}
    assert out[5]["text"] == EXAMPLES[4][1] and out[5]["n_replaced"] == 0
    assert [out[i]["n_replaced"] for i in (1, 2, 3, 4)] == [3, 4, 3, 5]
    for i, was in EXAMPLES[:4]:
        now = out[i]["text"]
        assert out[i]["n_chars"] == len(now)
        for entity in re.findall(r"[\w.]+@[\w.]+\w|\b\d{16}\b|[0-9a-f]{40}|152[\d.]+\d|John|Smith|Иван|3704", was):
            assert entity not in now or entity == "4041894974608796"
    upper, lower, other = re.findall(r"[\w.]+@[\w.]+\w", out[1]["text"])
    assert upper.lower() == lower and other != lower and other.split("@")[1] == lower.split("@")[1]
    phones = re.findall(r"\+1[\d ()-]+\d", out[2]["text"])
    assert len({re.sub(r"\D", "", p) for p in phones}) == 1 and "4041894974608796" in out[2]["text"]
    cards = re.findall(r"card (\d{16}) and ([\d-]{19})", out[2]["text"])[0]
    assert cards[0] == cards[1].replace("-", "") and luhn(cards[0])
    assert re.search(r'token = "[0-9a-f]{40}"### ip \d+\.\d+\.\d+\.\d+### v 999\.1\.1\.1 ssn \d{3}-\d{2}-\d{4}$', out[3]["text"])
    names = re.match(r"Mr\. (\w+) (\w+) met Frau (\w+) and Dr (\w+) (\w+)\. Mr ([а-яА-Я]+) ([а-яА-Я]+), IBAN (DE[\d ]+)\.$", out[4]["text"]).groups()
    assert names[1] == names[2] == names[4] and names[0] == names[3]  # Mr and Dr John: one name, one surrogate
    iban = names[7].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    again = {r["doc_id"]: r["text"] for r in pii.pseudonymised(table.repartition(5)).collect()}
    assert again == {i: r["text"] for i, r in out.items()}
    assert any(r["text"] != out[r["doc_id"]]["text"] for r in pii.pseudonymised(table, pii.Surrogates(key="other")).collect())
    rest = pii.pseudonymised(awkward)
    assert Counter((r["doc_id"], r["text"]) for r in rest.collect()) == Counter((r["doc_id"], r["text"]) for r in awkward.collect())
    assert set(rest.columns) == {*awkward.columns, "n_replaced"} and pii.pseudonymised(docs([])).count() == 0


def test_names_stay_whole_and_keep_one_surrogate(docs):
    texts = ["Ms. Anna-Maria Lopez came.", "Mr Jean-Luc Picard, later Picard alone, Picardy not.", "Monsieur D'Artagnan et D'Artagnan.",
             "Frau Müller-Lüdenscheidt", "Mr John Smith and Dr John Smith. John Smith left; Smith's hat.", "Mr McDonald", "Mrs Kim Smith. Mr Kim Smith.",
             "John Smith without a title here"]
    out = [r["text"] for r in pii.pseudonymised(docs([(i, t, "en", "s") for i, t in enumerate(texts)])).orderBy("doc_id").collect()]
    for real in ("Anna", "Maria", "Lopez", "Jean", "Luc", "Picard,", "Artagnan", "Müller", "Lüdenscheidt", "McDonald", "Donald"):
        assert not any(real in t for t in out[:7]), real
    assert "Picardy not." in out[1] and out[7] == texts[7]  # names are known within their own document
    assert re.fullmatch(r"Ms\. \w+na \w+rt came\.", out[0]) and re.fullmatch(r"Frau \w+rt", out[3])
    picard = re.fullmatch(r"Mr (\w+) (\w+), later (\w+) alone, Picardy not\.", out[1]).groups()
    assert picard[1] == picard[2]
    smith = re.fullmatch(r"Mr (\w+n) (\w+) and Dr (\w+) (\w+)\. (\w+) (\w+) left; (\w+)'s hat\.", out[4]).groups()
    assert len({smith[i] for i in (0, 2, 4)}) == 1 and len({smith[i] for i in (1, 3, 5, 6)}) == 1
    kim = re.fullmatch(r"Mrs (\w+) (\w+)\. Mr (\w+) (\w+)\.", out[6]).groups()
    assert kim[0] == kim[2] and kim[0].endswith("l") and kim[1] == smith[1]


def test_domains_stay_distinct(spark):
    a_z = "abcdefghijklmnopqrstuvwxyz"
    found = spark.createDataFrame([("email", f"me@{x}{y}.com") for x in a_z[:9] for y in a_z[:9]] + [("email", "you@aa.com")]
                                  + [("email", f"me@{x}.org") for x in a_z], "kind string, canon string")
    got = {r["canon"]: r["surrogate"] for r in pii.assign(found, pii.Surrogates(rounds=2)).collect()}
    domains = {c.split("@")[1]: s.split("@")[1] for c, s in got.items()}
    assert len(set(domains.values())) == len(domains) == 81 + 26 and not set(domains) & set(domains.values())
    assert got["you@aa.com"].split("@")[1] == domains["aa.com"] and all(s.rsplit(".", 1)[1] == c.rsplit(".", 1)[1] for c, s in domains.items())


def test_long_texts_of_every_alphabet(docs):
    n = 300_000
    made = ["a@b" + ".c" * (n // 2), "a@" * (n // 2), "a.b-c_d%" * (n // 8), "1-" * (n // 2), "+1 " * (n // 3), "12 34 " * (n // 6), "4111 " * (n // 5),
            "DE00 1234 " * (n // 10), "1." * (n // 2), "Mr A" * (n // 4), "Mr Aa-" + "Aa-" * (n // 3), "token=" * (n // 6), "token=1" + "x" * n, "sk-" + "a" * n,
            "(" * n, "a@" + "b-" * (n // 2) + ".com", "x@y.z " * (n // 6)]
    table = docs([(i, t, "en", "s") for i, t in enumerate(made)])
    out = {r["doc_id"]: r["text"] for r in pii.pseudonymised(table).collect()}
    assert len(out) == len(made) and out[2] == made[2] and out[14] == made[14] and "x@y.z" not in out[16] and made[12][8:] not in out[12]


def test_surrogates_stay_distinct(spark):
    found = spark.createDataFrame([("ip", f"10.0.{i // 200}.{i % 200}") for i in range(3000)] + [("ssn", f"{i:09d}") for i in range(3000)]
                                  + [("secret", f"a{i % 10}") for i in range(10)], "kind string, canon string")
    rows = pii.assign(found).collect()
    assert len(rows) == 6010 and len({(r["kind"], r["surrogate"]) for r in rows}) == 6010
    real = {(r["kind"], r["canon"]) for r in rows}
    assert not any((r["kind"], r["surrogate"]) in real for r in rows)


def test_surrogates_of_used_up_formats(spark):
    a_z = "abcdefghijklmnopqrstuvwxyz"
    rows = [("email", f"{x}{y}@mail.com") for x in a_z for y in a_z] + [("email", f"{i:02d}@post.org") for i in range(60)]
    rows += [("phone", f"+1{i:04d}") for i in range(7000)] + [("email", "_@x.org"), ("secret", "Ab-xyz9"), ("given_male", "john")]
    found = spark.createDataFrame(rows, "kind string, canon string")
    got = {(r["kind"], r["canon"]): r["surrogate"] for r in pii.assign(found, pii.Surrogates(rounds=2)).collect()}
    assert set(got) == set(rows) and len({(k, s.lower()) for (k, _), s in got.items()}) == len(rows)
    assert not any((k, s.lower()) in got for (k, _), s in got.items())
    longer = [s for (k, _), s in got.items() if k == "phone" and len(s) == 7]
    assert len(longer) == 7000 - 3000 and all(re.fullmatch(r"\+1\d{4,5}", s) for (k, _), s in got.items() if k == "phone")
    assert all(re.fullmatch(r"[a-z]{2}@[a-z]{4}\.com", got["email", c]) for k, c in rows if c.endswith("mail.com"))
    written = spark.createDataFrame([(f"+1 {i // 100:02d} {i % 100:02d}",) for i in range(7000)], "raw string")
    new = [r["new"] for r in pii.replacements(written, pii.Surrogates(rounds=1)).collect()]
    assert len(set(new)) == 7000 and all(re.fullmatch(r"\+1 \d\d \d\d\d?", x) for x in new)


# ------------------------------------------------------------------ shards

def test_shards(docs, awkward):
    from random import Random
    from zlib import crc32

    r = Random(6)
    rows = [(i, "x" * int(r.lognormvariate(5, 1)), r.choice(["en", "de", None]), r.choice(["a", "b", None])) for i in range(3000)]
    rows += [(10_000 + i, "copied text " * 30, "en", "a") for i in range(1500)] + [(20_000 + i, "few copies " * 9, "en", "b") for i in range(4)]
    rows += [(30_000, "one row many times " * 8, "en", "c")] * 500
    got = sharding.op10(docs(rows)).collect()
    assert len(got) == len(rows)
    load, slots, few = Counter(), defaultdict(list), set()
    for g in got:
        load[g["shard"]] += g["size"]
        slots[g["shard"]].append(g["slot"])
        if 20_000 <= g["doc_id"] < 20_004:
            few.add(g["shard"])
    mean = sum(load.values()) / 40
    assert set(load) == set(range(40)) and all(abs(v - mean) < 0.12 * mean for v in load.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(few) == 1
    want = Counter((i, len((t or "").encode()) + 16, crc32((t or "").encode())) for i, t, _, _ in rows)
    assert Counter((g["doc_id"], g["size"], g["text_crc32"]) for g in got) == want
    assert sharding.op10(awkward).count() == awkward.count() and sharding.op10(docs([])).count() == 0
    assert sharding.shards_for(docs(rows), 10**5) == -(-sum(load.values()) // 10**5)


def test_stages_keep_columns_named_like_their_own(docs):
    """Names that once were the operators' own."""
    rows = docs([(i, " ".join(f"w{i}x{k}" for k in range(i + 1)), "en", "ab"[i % 2]) for i in range(12)])
    extra = rows.withColumn("_copies", F.lit(5)).withColumn("_time", F.lit(7)).withColumn("_key", F.lit(9)).withColumn("_id", F.lit(3))
    for stage in (mixing.mixture, neardup.deduplicated):
        got = stage(extra)
        assert got.columns == extra.columns
        assert Counter(x["doc_id"] for x in got.collect()) == Counter(x["doc_id"] for x in stage(rows).collect())
        assert got.select("_copies", "_time", "_key", "_id").distinct().collect() == [(5, 7, 9, 3)]
