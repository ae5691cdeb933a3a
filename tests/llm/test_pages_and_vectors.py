"""Operators on pages and vectors, and the pipeline, against brute force and on awkward rows."""

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from titlesieve.llm import ann, markup, pages, urls

PAGES = "page_id long, url string, html string, host string, text string, path string"


def make(spark, rows):
    return spark.createDataFrame([(*r, "h", "t", "p") for r in rows], PAGES)


# ------------------------------------------------------------------ urls

def test_url_rules(spark):
    rows = [(1, "http://A.Example.NET/en/x?q#f", ""), (2, "https://example.net/fr/", None), (3, "https://example.net", None),
            (4, "http://shop.example.com/de/1", None), (5, "http://x.org/fr/1", None), (6, None, None), (7, "no scheme/de/", None),
            (8, "http://notexample.com/de/", None), (9, "http://org/fr/", None), (10, "http://h?x=://y/z", None)]
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.op7(make(spark, rows)).collect()}
    assert got[1] == ("a.example.net", "/en/x", "example.net/en/", "allow") and got[2][2:] == ("net/", "block")
    assert got[3] == ("example.net", "", None, "block")  # its host is blocked on another page
    assert got[4][2:] == ("example.com/de/", "block") and got[5][2:] == ("org/fr/", "allow") and got[9][2:] == ("org/fr/", "allow")
    assert got[6] == ("", "", None, "allow") and got[7] == ("", "", None, "allow") and got[8][2] is None and got[10][:2] == ("h", "")
    assert urls.op7(make(spark, [])).count() == 0


def test_trust_flows_along_links_and_distrust_against_them(spark):
    def links(*hosts):
        return "".join(f'<a href="http://{h}/">x</a>' for h in hosts)

    rows = [(1, "http://good.org/fr/", links("friend.com")), (2, "http://friend.com/", links("friendly.com")), (3, "http://friendly.com/", ""),
            (4, "http://bad.net/", links("victim.com")), (5, "http://spam.com/", links("bad.net", "bad.net")), (6, "http://farm.com/", links("spam.com")),
            (7, "http://victim.com/", ""), (8, "http://island.com/", "<a href='/local'>l</a>")] + [(9, "http://spam.com/", links("bad.net"))] * 2
    out = urls.judge(make(spark, rows)).collect()
    verdict = {r["page_id"]: r["verdict"] for r in out}
    assert [verdict[i] for i in range(1, 9)] == ["allow", "allow", "allow", "block", "block", "block", "allow", "allow"] and len(out) == len(rows)
    # the same scores by dense iteration
    hosts = sorted({r["host"] for r in out})
    at = {h: i for i, h in enumerate(hosts)}
    link = np.zeros((len(hosts), len(hosts)))
    for _, url, html in rows:
        for target in __import__("re").findall(r"href=\"http://([^/]+)", html):
            link[at[url.split("/")[2]], at[target]] += 1
    cfg = urls.LinkTrust()
    for name, matrix, seed in (("trust", link, "good.org"), ("distrust", link.T, "bad.net")):
        start = np.eye(len(hosts))[at[seed]]
        step, score = np.divide(matrix, matrix.sum(1, keepdims=True), where=matrix.sum(1, keepdims=True) > 0, out=np.zeros_like(matrix)), start
        for _ in range(200):
            score = (1 - cfg.damping) * start + cfg.damping * score @ step
        assert all(abs(r[name] - score[at[r["host"]]]) < 1e-8 for r in out)


def test_trust_reaches_the_ends_of_long_chains(spark):
    """A trusted host, twenty hosts in a row, a blocked one: the verdict turns where distrust outweighs trust; and a
    cycle, in which mass never comes to rest."""
    rows = [(0, "http://good.org/fr/", '<a href="http://h1.com/">x</a>')]
    rows += [(i, f"http://h{i}.com/", f'<a href="http://{"spam.net" if i == 20 else f"h{i + 1}.com"}/">x</a>') for i in range(1, 21)]
    rows += [(50, "http://a.com/", '<a href="http://b.com/">x</a>'), (51, "http://b.com/", '<a href="http://a.com/">x</a><a href="http://spam.net/">y</a>')]
    rows += [(60, "http://spam.net/", ""), (61, "http://good.org/", '<a href="http://a.com/">x</a>')]
    out = {r["page_id"]: r for r in urls.judge(make(spark, rows)).collect()}
    keep, d = 0.15, 0.85
    for i in range(1, 21):  # half of what good.org passes on goes into the chain, half of spam.net's distrust back up it
        assert abs(out[i]["trust"] - keep * 0.5 * d**i) < 1e-9 and abs(out[i]["distrust"] - keep * 0.5 * d**(21 - i)) < 1e-9
        assert out[i]["verdict"] == ("allow" if i <= 10 else "block")
    b = keep * 0.5 * d / (1 - d * d / 2)  # distrust of b.com: half of spam.net's, and half of what a.com got comes round
    assert abs(out[51]["distrust"] - b) < 1e-8 and abs(out[50]["distrust"] - d * b) < 1e-8


def test_targets_without_a_row_are_seeds(spark):
    def links(*urls_):
        return "".join(f'<a href="{u}">x</a>' for u in urls_)

    rows = [(1, "http://farm.com/", links("http://spam.net/a?b#c", "//SPAM.net/a?b")), (2, "http://home.com/", links("http://spam.net")),
            (3, "http://path.com/", links("http://shop.example.com/de/1")), (4, "http://other.com/", links("http://shop2.example.com/en/1")),
            (5, "http://crawled.net/x", links("http://friend.com/")), (6, "http://friend.com/", links("http://x.org/fr/1")), (7, "http://near.com/", links("http://crawled.net/x"))]
    table = make(spark, rows)
    assert [r["verdict"] for r in urls.judge(table).orderBy("page_id").collect()] == ["block"] * 3 + ["allow", "block", "allow", "block"]
    got = {r["host"]: (r["allowed"], r["blocked"]) for r in urls.target_seeds(table).collect()}
    assert got == {"spam.net": (0, 2), "shop.example.com": (0, 1), "x.org": (1, 0)}


# ------------------------------------------------------------------ main text

def test_common_lines():
    from random import Random

    r = Random(3)
    for _ in range(500):
        a, b = ([r.choice("abcd") for _ in range(r.randrange(12))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        found, rest = markup.shared(a, b), iter(b)
        assert len(found) == table[-1][-1] and all(a[i] in rest for i in sorted(found))


def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t='</p>';</script></head><body>{body}</body></html>"


def test_main_text(spark):
    def plain(i):
        return page(f"<div>Our great site</div><p>Opening {i} words &amp; more.</p><p>Body of page\n {i}<br>goes on.</p><div>All rights reserved</div>")

    marked = page("""<header><h1>Site</h1></header><div id="cookie-notice">We use cookies</div><nav><a href=x>Home</a></nav><article class="post">
        <h1>Title</h1><p><b>First &lt;one&gt;<br><p>Second  one</p><div class="ad">Buy</div><form>Name <input></form><!-- c --><div>Share</div></article>
        <section class="comments"><article class="comment"><p>Nice</p></article></section><aside>Side</aside><footer>&copy; me</footer>""")
    rows = [(i, f"http://a.com/news/{i}", plain(i)) for i in range(5)] + [(3, "http://a.com/news/3", plain(3))]
    rows += [(10, "http://b.com/1", marked), (11, "http://c.com/1", plain(11)), (12, None, None), (13, "http://d.com/", ""), (14, "x", "<p>cut <b>off <a hre")]
    got = [(r["page_id"], r["text"], r["n_chars"]) for r in pages.op6(make(spark, rows)).collect()]
    text = {i: t for i, t, _ in got}
    for i in range(5):
        assert text[i] == f"Opening {i} words & more.\n\nBody of page {i} goes on."
    assert text[10] == "Title\n\nFirst <one>\n\nSecond one\n\nShare" and text[12] == "" and text[13] == "" and text[14] == "cut off"
    assert text[11].startswith("Our great site")  # no neighbour to differ from
    assert len(got) == len(rows) and all(n == len(t) for _, t, n in got)
    assert pages.op6(make(spark, [])).count() == 0


def test_lines_outside_an_article_are_differenced(spark):
    def beside(i):
        return page(f"<div>Our site</div><article><p>Story {i}</p><p>Passage of all</p></article><p>Correction {i}</p><footer>Own {i}</footer><p>Hours 9 to 5</p>")

    got = {r["page_id"]: r["text"] for r in pages.op6(make(spark, [(i, f"http://a.com/n/{i}", beside(i)) for i in range(4)])).collect()}
    assert got == {i: f"Story {i}\n\nPassage of all\n\nCorrection {i}" for i in range(4)}


def test_template_longer_than_text_and_copies(spark):
    template = "".join(f"<div>Template {k}</div>" for k in range(8))

    def short(i):
        return page(template + "".join(f"<p>Own {i} {k}</p>" for k in range(3)))

    rows = [(i, f"http://a.com/n/{i}", short(i)) for i in range(3)]
    rows += [(10 + i, f"http://b.com/n/1{i:02d}", short(9)) for i in range(20)] + [(40, "http://b.com/n/z", short(8))]  # a usable page behind copies
    got = {r["page_id"]: r["text"] for r in pages.op6(make(spark, rows)).collect()}
    want = {**{i: i for i in range(3)}, **{10 + i: 9 for i in range(20)}, 40: 8}
    assert got == {i: "\n\n".join(f"Own {n} {k}" for k in range(3)) for i, n in want.items()}


def test_blocks_split_equal_paths_and_show_neighbours(spark):
    cfg = pages.Differencing(group=10)

    def templated(i):  # true neighbours alone share a line
        return page(f"<p>Own {i} a</p><p>Own {i} b</p><div>Pair {i // 2}</div>")

    rows = [(i, f"http://a.com/index.php?id={1000 + i}", templated(i)) for i in range(101)]
    rows += [(200 + i, f"http://b.com/c/{i:03d}", templated(900)) for i in range(60)] + [(300, "http://b.com/d", templated(901))]
    table = make(spark, rows)
    got = {r["page_id"]: r["text"] for r in pages.extract(table, cfg).collect()}
    for i in range(101):  # of two equally near pages the one before serves
        assert got[i] == f"Own {i} a\n\nOwn {i} b" + (f"\n\nPair {i // 2}" if i and i % 2 == 0 else "")
    assert all(got[200 + i] == "Own 900 a\n\nOwn 900 b" for i in range(60)) and len(got) == len(rows)
    ranked = pages._ranked(pages.parsed(table))
    assert sorted(r["rank"] for r in ranked.select("rank").collect()) == list(range(len(rows)))
    shown = pages._blocks(ranked, len(rows), cfg).groupBy("block").agg(F.count("*").alias("n"), F.sum(F.col("own").cast("int")).alias("own")).collect()
    assert all(r["own"] <= 10 and r["n"] <= 40 for r in shown) and sum(r["own"] for r in shown) == len(rows)


# ------------------------------------------------------------------ neighbours

def test_neighbours(spark):
    r = np.random.default_rng(8)
    centres = r.standard_normal((12, 24))
    rows = [(i, [float(x) for x in (centres[i % 12] + 0.4 * r.standard_normal(24)).astype(np.float32)], 0) for i in range(1500)]
    rows += [(2000 + i, rows[0][1], 0) for i in range(30)]  # copies tie to the smaller id
    rows += [(5000, None, 0), (5050, [], 0), (5100, [0.0] * 24, 0), (5150, [float("nan")] * 24, 0), (5200, [None] + [1.0] * 23, 0),
             (5250, [float("inf")] * 24, 0), (None, [1.0] * 24, 0), (5300, [1.0, 2.0], 0), (5301, [2.0, 1.0], 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    got = {}
    for x in ann.op9(table).orderBy("query_id", "rank").collect():
        got.setdefault(x["query_id"], []).append((x["rank"], x["vec_id"], x["score"]))
    good = [(i, np.array(v, dtype=np.float64)) for i, v, _ in rows if i is not None and i < 5000]
    ids, m = np.array([i for i, _ in good]), np.array([v for _, v in good])
    length, hits, asked = np.sqrt((m * m).sum(1)), 0, 0
    for q in np.flatnonzero(ids % 50 == 0):
        score = (m * m[q]).sum(1) / (length * length[q])
        score[q] = -9
        best = ids[np.lexsort((ids, -score))[:5]]
        found = got[ids[q]]
        asked, hits = asked + 5, hits + len({i for _, i, _ in found} & set(best))
        assert [k for k, _, _ in found] == [1, 2, 3, 4, 5]
        assert all(abs(s - score[np.flatnonzero(ids == i)[0]]) < 1e-14 for _, i, s in found)
        assert found == sorted(found, key=lambda f: (-f[2], f[1]))
    assert hits / asked >= 0.95 and [i for _, i, _ in got[0]] == [2000, 2001, 2002, 2003, 2004]
    assert [i for _, i, _ in got[5300]] == [5301] and set(got) == {*(int(i) for i in ids if i % 50 == 0), 5300}
    assert ann.op9(table.limit(0)).count() == 0


# ------------------------------------------------------------------ pipeline

def test_pipeline(spark, tmp_path):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, before = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, folder)
        after.write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        if name != "tokens":
            assert after.columns == columns
        if name in ("language", "near_duplicates"):
            assert 0.8 * before.count() < after.count() <= before.count()
        if name == "personal_data":
            assert after.count() == before.count()
            assert after.join(before.select("doc_id", F.col("text").alias("was")), "doc_id").filter("text <> was").count() > 0
        before = after
    assert before.filter("NOT decodes").count() == 0 and before.agg(F.sum("n_tokens")).first()[0] > 0
    assert corpus_pipeline.run(spark, folder).count() == before.count()
    assert corpus_pipeline.STAGES[0][1](spark, docs.limit(0), folder).count() == 0
