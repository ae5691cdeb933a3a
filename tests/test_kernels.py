import numpy as np
from brute import dot, lcs, token_set, token_sort
from hypothesis import given, settings
from hypothesis import strategies as st

from titlesieve.functions.lcs import TitleBlock, indel_scores, lcs_lengths, token_set_scores, token_sort_scores
from titlesieve.functions.vectors import best_by_inner_product

letters = st.text(alphabet="ab cé𝄞", max_size=150)
words = st.lists(st.sampled_from(["news", "the", "a", "ab", "ba", "é", "weekly", "x" * 70, "daily"]), max_size=7)
titles = words.map(" ".join)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(letters, letters), min_size=1, max_size=12))
def test_lcs_equals_dynamic_programme(pairs):
    a, b = zip(*pairs)
    assert lcs_lengths(a, b).tolist() == [lcs(x, y) for x, y in pairs]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(titles, titles), min_size=1, max_size=20))
def test_ratios(pairs):
    a, b = zip(*pairs)
    assert token_set_scores(a, b).tolist() == [token_set(x, y) for x, y in pairs]
    assert token_sort_scores(a, b).tolist() == [token_sort(x, y) for x, y in pairs]
    assert token_set_scores(a, b).tolist() == token_set_scores(b, a).tolist()


@settings(max_examples=60, deadline=None)
@given(st.lists(titles, min_size=1, max_size=60), st.lists(titles, min_size=1, max_size=5), st.integers(1, 8),
       st.sampled_from([0.0, 40.0, 60.0, 90.0]))
def test_block_search_equals_full_scan(block, asked, k, floor):
    got = list(TitleBlock(block, np.arange(len(block))).best(asked, k, floor, pairs=100))
    for q, (rows, scores) in zip(asked, got):
        if not q.split():
            assert len(rows) == 0
            continue
        ranked = sorted((-token_set(q, t), i) for i, t in enumerate(block) if t.split())[:k]
        assert [(-s, i) for s, i in ranked if -s >= floor] == list(zip(scores.tolist(), rows.tolist()))


def test_worked_ratios():
    assert round(indel_scores(["this is a test"], ["this is a test!"])[0], 4) == 96.5517
    assert token_set_scores(["fuzzy was a bear"], ["fuzzy fuzzy was a bear"])[0] == 100
    assert round(token_set_scores(["climate news"], ["klimat newz"])[0], 4) == 78.2609


def test_inner_product_search_with_copies_and_zero_vectors():
    gen = np.random.default_rng(5)
    for trial in range(40):
        d, k = int(gen.integers(1, 12)), int(gen.integers(1, 9))
        base = gen.normal(size=(9, d)).astype(np.float32)
        corpus = base[gen.integers(0, 9, size=50)]
        queries = np.concatenate([gen.normal(size=(6, d)).astype(np.float32), base[:3], np.zeros((2, d), np.float32)])
        ids = gen.permutation(500)[:50].astype(np.int64)
        rows, got, sims = best_by_inner_product(queries, corpus, ids, k, budget=30)
        for q in range(len(queries)):
            want = sorted((-dot(queries[q], c), int(i)) for c, i in zip(corpus, ids))[:k]
            mine = rows == q
            assert [(-s, i) for s, i in zip(sims[mine].tolist(), got[mine].tolist())] == want


def test_counts_of_very_long_titles_do_not_wrap():
    """Letter counts and token numbers beyond 16 bits, on which the bounds of the search rest."""
    assert TitleBlock(["a" * 65_600 + "b", "short"], np.arange(2)).bag.max() == 65_600
    many = " ".join(f"t{i}" for i in range(33_000))
    assert TitleBlock([many], np.arange(1)).owner.max() == 32_999


@settings(max_examples=15, deadline=None)
@given(st.lists(titles, min_size=1, max_size=40), st.lists(titles, min_size=1, max_size=6), st.sampled_from([0.0, 60.0]))
def test_a_large_block_is_searched_as_a_small_one(block, asked, floor):
    """Bounds by letter counts and match words brought together, also for counts that few titles reach."""
    many = [f"{t} {'ab' * (i % 3)}".strip() for i, t in enumerate((block * 2100)[:2100])] + ["aaaa" * 30, "é" * 40]
    large = TitleBlock(many, np.arange(len(many)))
    assert large.tables is not None and large.levels is not None
    for q, (rows, scores) in zip(asked, large.best(asked, 5, floor)):
        if not q.split():
            assert len(rows) == 0
            continue
        found = token_set_scores([q] * len(many), many).tolist()
        ranked = sorted((-s, i) for i, (s, t) in enumerate(zip(found, many)) if t.split())[:5]
        assert [(-s, i) for s, i in ranked if -s >= floor] == list(zip(scores.tolist(), rows.tolist()))


def test_blocks_of_long_titles_keep_to_their_bounds():
    block = TitleBlock(["a" * 700 + "b", *map(chr, range(0x4E00, 0x4E00 + 900))], np.arange(901))
    assert block.tables is None
    assert [r.tolist() for r, _ in block.best(["a" * 700, chr(0x4E07)], 2, 60.0)] == [[0], [8]]
