"""Near duplicates where many members of a family lie just below the threshold."""

from collections import Counter
from random import Random

import numpy as np
import pyarrow as pa
import pytest
from test_documents import linked

from titlesieve.llm import neardup, shingles


def family(members, seed, words=60, changes=3):
    """Texts of one base with changed words each: most pairs have a similarity between 0.6 and 0.85."""
    r, rows = Random(seed), []
    base = [f"w{i}" for i in range(words)]
    for i in range(members):
        text = list(base)
        for at in r.sample(range(words), r.choice([changes - 1, changes])):
            text[at] = f"new{i}x{at}"
        rows.append((i, " ".join(text)))
    return rows


def pairs_across(docs, rows, cfg, monkeypatch):
    """Rows that the comparison across components gives out, and the result."""
    counted = []
    across = neardup._across

    def watched(*args):
        out = neardup.cut(across(*args))
        counted.append(out.count())
        return out

    monkeypatch.setattr(neardup, "_across", watched)
    got = neardup.near_duplicates(docs([(i, t, "en", "s") for i, t in rows]), cfg).collect()
    monkeypatch.setattr(neardup, "_across", across)
    return sum(counted), got


def test_a_family_below_the_threshold_hardly_meets(docs, monkeypatch):
    made = {}
    for n in (80, 160):
        rows = family(n, 3)
        cfg = neardup.NearDup(words=4, block_rows=50, turns=1, leaders=1)
        made[n], got = pairs_across(docs, rows, cfg, monkeypatch)
        assert Counter(tuple(g)[:3] for g in got) == Counter(linked(rows))
    assert made[160] < 0.5 * 160 * 159 / 2 and made[160] < 3 * made[80] + 500, made


def test_parity_of_whole_sets_keeps_similar_pairs():
    cfg, draw = neardup.NearDup(), np.random.default_rng(4)
    kept = {True: 0, False: 0}
    for n in (40, 300, 3900, 4200, 20_000, 60_000):
        for share, wanted in ((0.2 / 1.8, True), (0.35 / 1.65, False)):
            for _ in range(20):
                both = draw.integers(1, 2**63, size=n, dtype=np.int64).view(np.uint64)
                differ = int(n * share)  # of each side, so the similarity is (n - d) / (n + d)
                a, b = both, np.concatenate([both[differ:], draw.integers(1, 2**63, size=differ, dtype=np.int64).view(np.uint64)])
                table = pa.table({
                    "cid": [1, 2], "root": [1, 2], "n_shingles": [len(a), len(b)], "side": [0, 0], "band": [5, 5], "low": [0, 0], "high": [0, 0],
                    "bands": [[5, 6], [5, 7]], "sketch": [[0] * 32] * 2,
                    "parity": [neardup._parity(np.sort(x), cfg).tolist() for x in (a, b)]})
                kept[wanted] += neardup._open_pairs(table, cfg).num_rows
    assert kept[True] == 120 and kept[False] <= 12


def test_sizes_on_both_sides_of_a_level():
    cfg = neardup.NearDup()
    for n in (4096, 4097, 3277, 3276, 8192):
        x = np.arange(1, n + 1, dtype=np.uint64)
        more = np.arange(1, int(n / 0.81), dtype=np.uint64)
        level, above = cfg.level(np.array([len(x), len(more)]))
        own, other = neardup._parity(x, cfg), neardup._parity(more, cfg)
        assert above - level in (0, 1) and (above == level or len(own) == 64)
        table = pa.table({
            "cid": [1, 2], "root": [1, 2], "n_shingles": [len(more), len(x)], "side": [0, 0], "band": [5, 5], "low": [0, 0], "high": [0, 0],
            "bands": [[5, 6], [5, 7]], "sketch": [[0] * 32] * 2, "parity": [other.tolist(), own.tolist()]})
        assert neardup._open_pairs(table, cfg).num_rows == 1


def test_pieces_of_a_batch_are_bounded():
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * 3_000_000] * 5 + [None, ""] + ["y"] * 4)], names=["text"])
    pieces = list(shingles.sliced(iter([batch]), "text"))
    assert sum(p.num_rows for p in pieces) == batch.num_rows and [p.num_rows for p in pieces] == [1, 1, 1, 1, 7]


@pytest.mark.parametrize("bits", [1 << 26, 0])
def test_one_document_of_each_group_stays(docs, monkeypatch, bits):
    """By brute force, with and without the filter that leaves settled documents in place."""
    monkeypatch.setattr(neardup, "_MOST_SIEVE_BITS", bits)
    r = Random(9)
    rows = family(40, 5) + [(100 + i, " ".join(r.choices("abcdefgh", k=30))) for i in range(20)]
    rows += [(i + 200, t) for i, t in rows[:15]] + rows[50:56] + [(300, ""), (300, ""), (301, None), (302, " \t\n")]
    cfg = neardup.NearDup(words=4)
    want = Counter({(i, t): 1 for (i, t), (_, n, c) in zip(rows, linked(rows)) if n and i == c})
    want += Counter((i, t) for i, t in rows if not (t or "").split())
    got = neardup.deduplicated(docs([(i, t, "en", "s") for i, t in rows]), cfg).collect()
    assert Counter((x["doc_id"], x["text"]) for x in got) == want
