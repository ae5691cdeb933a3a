"""Products with a wide table are made in pieces; what is kept of them is what the whole matrix would show."""

import tracemalloc

import numpy as np

from titlesieve.functions import vectors


def test_pieces_keep_what_the_whole_matrix_shows():
    gen = np.random.default_rng(11)
    q, c = gen.normal(size=(7, 5)).astype(np.float32), gen.normal(size=(3_001, 5)).astype(np.float32)
    c[100:140] = c[99]
    whole = set(zip(*(a.tolist() for a in vectors._near_best(q @ c.T, 4, 1e-4, 0))))
    for cells in (7, 999, 1 << 16):
        rows, cols = vectors._near_best_products(q, c, 4, 1e-4, np.empty(cells, dtype=np.float32))
        assert rows.tolist() == sorted(rows.tolist()) and set(zip(rows.tolist(), cols.tolist())) == whole


def test_few_places():
    gen = np.random.default_rng(12)
    for shape in ((3, 5), (4, 16), (1, 7), (6, 0), (5, 1_001)):
        for share in (0.0, 0.01, 1.0):
            flags = gen.random(shape) < share
            assert vectors._few_places(flags).tolist() == np.flatnonzero(flags).tolist()


def test_a_wide_search_holds_no_whole_matrix():
    gen = np.random.default_rng(13)
    q, c = gen.normal(size=(64, 4)).astype(np.float32), gen.normal(size=(40_000, 4)).astype(np.float32)
    tracemalloc.start()
    rows, _, sims = vectors.best_by_inner_product(q, c, np.arange(40_000), 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 10_000_000  # the products alone are 10,240,000 bytes
    assert len(rows) == 192 and np.allclose(sims.reshape(64, 3), -np.sort(-(q.astype(float) @ c.T.astype(float)), axis=1)[:, :3])
