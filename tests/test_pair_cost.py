"""What the searches of pairs spare: copies of a title, rows that rare letters rule out, values far from the best."""

import random

import numpy as np
from brute import token_set

from titlesieve.config import ScreeningConfig
from titlesieve.functions import vectors
from titlesieve.functions.lcs import TitleBlock, _Asked
from titlesieve.operators import fuzzy


def test_copies_of_a_title_are_searched_once_in_a_cluster(spark, monkeypatch):
    asked = [(i, ["climate news", "daily sports", None, ""][i % 4], [[1, 2], [2], [1], []][i % 4 if i % 8 < 4 else 0]) for i in range(80)]
    asked += [(0, "daily sports", [1]), (7, "news weekly", [2, 2])]  # an id twice, a cluster twice
    rows = [(1, "climate news today", 5, 9), (1, "sports daily", 6, 6), (2, "climate news", 3, 3), (2, "news weekly x", 4, 8),
            (2, "sports daily", 1, 2)]
    proposals = spark.createDataFrame(asked, "proposal_id long, title string, cluster_ids array<int>")
    titles = spark.createDataFrame(rows, "cluster_id int, title string, first_id long, last_id long")
    searched, product = [], fuzzy.block_product

    def counted(left, *rest):
        searched.append(left.count())
        return product(left, *rest)

    monkeypatch.setattr(fuzzy, "block_product", counted)
    cfg = ScreeningConfig(top_k=2)
    got = fuzzy.fuzzy_hits(fuzzy.probe_rows(proposals), titles, cfg).collect()
    assert searched == [len({(q, c) for _, q, cs in asked if q is not None for c in cs})]
    want = set()
    for who in {i for i, _, _ in asked}:
        found = {}
        for i, q, cs in asked:
            for c, t, first, last in rows if i == who and q else ():
                if c in cs and token_set(q, t) >= cfg.fuzzy_floor:
                    score, place, _ = found.get(t, (0, first, 0))
                    found[t] = max(score, token_set(q, t)), min(place, first), 0
        clusters = {c for i, _, cs in asked if i == who for c in cs}
        best = sorted(found.items(), key=lambda f: (-f[1][0], f[1][1]))[:cfg.top_k]
        for rank, (t, (score, _, _)) in enumerate(best, 1):
            want.add((who, max(last for c, x, _, last in rows if x == t and c in clusters), t, round(score, 9), rank))
    assert {(r["proposal_id"], r["id"], r["title"], round(r["score"], 9), r["lex_rank"]) for r in got} == want and len(got) == len(want)


def test_letters_that_few_titles_have_rule_out_the_others():
    rnd = random.Random(3)
    titles = ["".join(rnd.choice("abcde") for _ in range(20)) for _ in range(2100)]
    titles[:12] = ["zzzzzzzzzz" + t[:10] for t in titles[:12]]  # more than one in 400, fewer than one in 100
    block = TitleBlock(titles, np.arange(2100))
    asked = _Asked(block, "zzzzzzzzzz")
    bag = np.minimum(asked.letters(len(block.most)), block.most)
    assert bag.sum() == 10  # no z is granted to titles without one
    (rows, scores), = block.best(["zzzzzzzzzz"], 20, 60.0)
    assert sorted(rows.tolist()) == list(range(12)) and np.allclose(scores, token_set("zzzzzzzzzz", titles[0]))


def test_few_values_of_a_wide_matrix_are_ranked():
    gen = np.random.default_rng(7)
    for rough in (gen.normal(size=(5, 2000)), np.sort(gen.normal(size=(5, 2000)), axis=1), gen.integers(0, 40, (5, 2000))):
        rough = rough.astype(np.float32)
        bar = np.sort(rough, axis=1)[:, -3] - np.float32(0.01)
        for sample in (0, 8):
            found = vectors._near_best(rough, 3, 0.01, sample)
            assert [a.tolist() for a in found] == [a.tolist() for a in np.nonzero(rough >= bar[:, None])]


def test_a_wide_search_equals_a_sort_of_all_products():
    gen = np.random.default_rng(8)
    corpus, queries = gen.normal(size=(1500, 6)).astype(np.float32), gen.normal(size=(9, 6)).astype(np.float32)
    ids = gen.permutation(1500).astype(np.int64)
    rows, got, sims = vectors.best_by_inner_product(queries, corpus, ids, 4, budget=4500)
    every = np.zeros((9, 1500))
    for d in range(6):
        every += queries[:, [d]].astype(np.float64) * corpus[:, d].astype(np.float64)
    for q in range(9):
        order = np.lexsort((ids, -every[q]))[:4]
        assert got[rows == q].tolist() == ids[order].tolist() and sims[rows == q].tolist() == every[q][order].tolist()
