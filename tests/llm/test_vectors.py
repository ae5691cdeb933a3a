"""Codes, cap filters and whitening against brute force, and on awkward rows."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from titlesieve.llm import caps, codes, whitening

ROWS = ("vec_id long, embedding array<float>, label int, code string, n long, cid long, component int, n_links string, root string, "
        "h string, n_shingles long, filters string, copies string")


def make(spark, rows):
    return spark.createDataFrame([(i, v, k, "c", 1, 2, 3, "l", "r", "h", 4, "f", "p") for i, v, k in rows], ROWS)


def draw(n, d, seed, spread=1.0):
    x = np.random.default_rng(seed).standard_normal((n, d)).astype(np.float32)
    return x * np.float32(spread)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, zero, non-finite and short vectors, null and repeated ids, repeated rows."""
    x = draw(40, 32, 1)
    rows = [(i, v.tolist(), i % 3 if i % 4 else None) for i, v in enumerate(x)]
    rows += [(0, x[0].tolist(), 1), (0, x[0].tolist(), 1), (7, x[20].tolist(), None), (None, x[3].tolist(), 2), (None, None, None), (100, None, 1),
             (101, [], 1), (102, [0.0] * 32, 0), (103, [1.0] * 31 + [math.nan], 0), (104, [math.inf] + [1.0] * 31, 0), (105, [None] + [1.0] * 31, 0),
             (106, [1.0, 2.0, 3.0], 0), (107, [2.0, 4.0, 6.0], 0), (108, [5.0], None)]
    return rows, make(spark, rows)


def good(rows, length):
    return [(i, np.array(v, dtype=np.float64), k) for i, v, k in rows
            if v and None not in v and all(math.isfinite(a) for a in v) and len(v) == length]


# ------------------------------------------------------------------ codes

@pytest.mark.parametrize("n, width, spread", [(64, 4, 60), (64, 4, 2), (9, 3, 5), (1, 4, 5), (64, 1, 4), (64, 12, 40), (200, 2, 30)])
def test_tree_finds_what_a_scan_finds(n, width, spread):
    entries, asked = (np.floor(draw(m, width, m + width, spread)).astype(np.int64) for m in (n, 3000))
    at, square, measured = codes.Gnat(entries, 8).nearest(asked)
    all_ = ((asked[:, None] - entries[None]) ** 2).sum(axis=2)
    assert (at == all_.argmin(axis=1)).all() and (square == all_.min(axis=1)).all()  # argmin takes the lower index of a tie
    assert measured <= n * len(asked) and (width > 4 or n < 64 or measured < 0.6 * n * len(asked))


def coded_plainly(rows, cfg):
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1].tolist()))
    x = np.array([np.floor(cfg.scale * r[1]) for r in rows]).astype(int)
    cut = [x.shape[1] * p // cfg.parts for p in range(cfg.parts + 1)]
    books = [x[: cfg.entries, a:b].copy() for a, b in zip(cut, cut[1:])]

    def assign():
        away = [((x[:, None, a:b] - book[None]) ** 2).sum(axis=2) for a, b, book in zip(cut, cut[1:], books)]
        return [w.argmin(axis=1) for w in away], sum(w.min(axis=1) for w in away)

    for _ in range(cfg.rounds):
        entry, _ = assign()
        for p, (a, b) in enumerate(zip(cut, cut[1:])):
            for e in set(entry[p]):
                own = x[entry[p] == e, a:b]
                books[p][e] = [int(s) // len(own) for s in own.sum(axis=0)]
    entry, error = assign()
    told = hashlib.sha256(",".join(str(v) for b in books for r in b for v in r).encode()).hexdigest()
    by_label = {}
    for r, e in zip(rows, error):
        by_label[r[2]] = by_label.get(r[2], 0) + int(e)
    return sorted((-1 if r[0] is None else r[0], "".join(f"{entry[p][i]:02x}" for p in range(cfg.parts)), int(error[i]), by_label[r[2]], told)
                  for i, r in enumerate(rows))


def told(df):
    return sorted((-1 if r[0] is None else r[0], *r[1:]) for r in df.collect())


def test_codes_equal_plain_quantisation(spark, odd):
    rows = [(i, v.tolist(), i % 5) for i, v in enumerate(draw(300, 32, 3))] + [(i + 500, v.tolist(), None) for i, v in enumerate(draw(40, 32, 3))]
    assert told(codes.op11(make(spark, rows))) == coded_plainly(good(rows, 32), codes.Codes())
    rows, frame = odd
    assert told(codes.op11(frame)) == coded_plainly(good(rows, 32), codes.Codes())
    far = [(1, [1.0, 2.0], 0), (2, [70000.0, 1.0], 0), (3, [1.0], 0)]  # fewer components than parts, out of range, another length
    assert told(codes.op11(make(spark, far))) == coded_plainly(good(far[:1], 2), codes.Codes())
    assert codes.op11(make(spark, [])).count() == 0 and codes.op11(make(spark, [(1, None, 1)])).count() == 0


def test_many_labels_are_joined_in_salted_parts(spark, monkeypatch):
    rows = [(i, v.tolist(), i // 10 if i > 50 else None) for i, v in enumerate(draw(200, 16, 4))]
    want = told(codes.op11(make(spark, rows)))
    monkeypatch.setattr(codes, "_LABELS", 3)
    assert told(codes.op11(make(spark, rows))) == want == coded_plainly(good(rows, 16), codes.Codes())


# ------------------------------------------------------------------ cap filters

def linked_plainly(rows, cosine):
    usable = [i for i, (_, v, _) in enumerate(rows) if v and None not in v and all(math.isfinite(a) for a in v) and any(v)]
    x = {i: np.array(rows[i][1], dtype=np.float64) for i in usable}
    near = {i: [j for j in usable if j != i and len(x[i]) == len(x[j]) and
                (x[i] * x[j]).sum() / (np.sqrt((x[i] ** 2).sum()) * np.sqrt((x[j] ** 2).sum())) >= cosine] for i in usable}
    out = []
    for i, (vec_id, _, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            new = set(near.get(todo.pop(), ())) - seen
            seen |= new
            todo += new
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        least = min(ids) if ids else None
        out.append((vec_id, len(near.get(i, ())), least, vec_id is not None and vec_id == least))
    return sorted(out, key=str)


def families(seed, d=64, sizes=(1, 1, 1, 2, 5, 40, 150), noise=(0.02, 0.2, 0.33)):
    """Copies of a centre with as much noise as lies around the threshold of 0.95."""
    draw_, rows = np.random.default_rng(seed), []
    for k, size in enumerate(sizes * 3):
        centre = draw_.standard_normal(d)
        for _ in range(size):
            v = centre + noise[k % 3] * draw_.standard_normal(d)
            rows.append((len(rows) + 1, (v * draw_.uniform(0.5, 2)).astype(np.float32).tolist(), 0))
    return rows


@pytest.mark.parametrize("block_rows", [2048, 30])
def test_links_equal_all_pairs(spark, block_rows):
    rows = families(7) + [(900 + i, families(8)[9][1], 0) for i in range(120)]  # a vector on a sixth of all rows
    cfg = caps.Caps(block_rows=block_rows)
    got = caps.near_vectors(make(spark, rows), cfg).collect()
    want = linked_plainly(rows, cfg.cosine)
    assert sum(w[1] for w in want) > 20_000
    assert sorted((tuple(r) for r in got), key=str) == want


def test_links_of_awkward_rows(spark, odd):
    rows, frame = odd
    assert sorted((tuple(r) for r in caps.op12(frame).collect()), key=str) == linked_plainly(rows, 0.95)
    assert caps.op12(make(spark, [])).count() == 0
    assert [tuple(r) for r in caps.op12(make(spark, [(3, None, 0)])).collect()] == [(3, 0, 3, True)]


@pytest.mark.parametrize("length, words", [(64, 16), (64, 128), (100, 64), (5, 32)])
def test_recall_of_pairs_at_the_threshold(length, words):
    cfg = caps.Caps()
    code, draw_ = caps.ProductCodes(length, words, cfg), np.random.default_rng(99)
    x, z = draw_.standard_normal((2, 1500, length))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    y = cfg.cosine * x + math.sqrt(1 - cfg.cosine**2) * z / np.linalg.norm(z, axis=1, keepdims=True)
    (rx, fx), (ry, fy) = code.decode(x), code.decode(y)
    shared = np.intersect1d(rx * 10**9 + fx, ry * 10**9 + fy) // 10**9
    count = np.bincount(shared, minlength=1500)
    assert (count > 0).mean() > 0.998 and 0.8 * cfg.common < count.mean() < 1.25 * cfg.common
    # the list is every filter over the bound
    for c, parts in enumerate(code.codes[:3]):
        all_ = x[0] @ parts[0]
        for p in parts[1:]:
            all_ = (all_[:, None] + x[0] @ p).ravel()
        assert set(np.flatnonzero(all_ >= code.bound) + c * len(all_)) == {f for f in fx[rx == 0] if f // len(all_) == c}


# ------------------------------------------------------------------ whitening

def check_whitened(got, rows, length, cfg):
    x = np.array([np.floor(cfg.scale * v) + cfg.shift for _, v, _ in good(rows, length)])
    n = len(x)
    centred = x - x.mean(axis=0)
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(cfg.components, length, int((values > 1e-9 * max(values[0], 1e-300)).sum()))
    assert len(got) == n * k and {r["n"] for r in got} <= {n}
    if not got:
        return
    assert got[0]["identity_error"] < 1e-9 and len({r["identity_error"] for r in got}) == 1
    whole = [[int(a) for a in r] for r in x]
    sums = [sum(c) for c in zip(*whole)]
    deviation = sorted(sum((n * a - s) ** 2 for a, s in zip(r, sums)) for r in whole)
    assert sorted(r["deviation"] for r in got if r["component"] == 1) == deviation
    for c in range(1, k + 1):
        own = [r for r in got if r["component"] == c]
        assert all(abs(r["explained"] * values.sum() / values[c - 1] - 1) < 1e-9 for r in own)
        want = np.sort(centred @ vectors[:, c - 1] / np.sqrt(values[c - 1]))
        mine = np.sort([r["whitened"] for r in own])
        assert min(np.abs(mine - want).max(), np.abs(mine + want[::-1]).max()) < 1e-7


def test_whitening_equals_a_dense_solution(spark):
    cfg = whitening.Whitening()
    turn, _ = np.linalg.qr(draw(80, 80, 11))
    x = draw(600, 80, 12) * np.linspace(3, 0.5, 80) @ turn + 5  # more dimensions than the block has
    rows = [(i, v.astype(np.float32).tolist(), 0) for i, v in enumerate(x)]
    check_whitened(whitening.whitened(make(spark, rows), cfg).collect(), rows, 80, cfg)
    found = whitening.leading(whitening.Rows(make(spark, rows), cfg), cfg)
    assert found.passes > cfg.degree and (found.residuals <= cfg.stalled * found.values[0]).all()


def test_whitening_of_awkward_rows(spark, odd):
    cfg = whitening.Whitening()
    rows, frame = odd
    check_whitened(whitening.op13(frame).collect(), rows, 32, cfg)
    few = [(i, v.tolist(), 0) for i, v in enumerate(draw(3, 64, 5))]  # two components have variance
    check_whitened(whitening.op13(make(spark, few)).collect(), few, 64, cfg)
    for rows in ([], [(1, None, 0)], [(1, [1.0, 2.0], 0)], [(i, [1.0, 2.0], 0) for i in range(5)]):
        assert whitening.op13(make(spark, rows)).count() == 0
    plane = [(i, [float(i), 2.0 * i], 0) for i in range(10)]
    assert whitening.op13(make(spark, plane)).filter(F.col("component") > 1).count() == 0


def test_deviations_beyond_a_long_are_null(spark):
    rows = whitening.op13(make(spark, [(i, [60000.0 * (i % 2), 1.0 * i], 0) for i in range(2000)])).collect()
    assert rows and all(r["deviation"] is None or r["deviation"] < 2**63 for r in rows)
