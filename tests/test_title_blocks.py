"""Blocks of titles searched one after the other, with what earlier ones found as the bar of later ones."""

import random

import numpy as np
import pyarrow as pa
from brute import token_set

from titlesieve.config import ScreeningConfig
from titlesieve.functions.lcs import TitleBlock, _Asked, token_set_scores
from titlesieve.operators import fuzzy

WORDS = [a + b for a in ("clim", "ne", "dai", "glob", "spo", "wee") for b in ("ate", "ws", "ly", "al", "rts", "kly", "x")]


def made(seed, n):
    rnd = random.Random(seed)
    return list(dict.fromkeys(" ".join(rnd.choice(WORDS) for _ in range(rnd.randint(1, 7))) + f" {i % 97}" for i in range(n)))


def test_later_blocks_know_what_earlier_ones_found(monkeypatch):
    titles, queries = made(1, 9_000), [*made(2, 12), made(2, 1)[0], None, ""]
    seen, best = [], TitleBlock.best

    def noted(self, asked, k, floor):
        seen.append(np.array(floor))
        return best(self, asked, k, floor)

    monkeypatch.setattr(TitleBlock, "best", noted)
    cfg = ScreeningConfig(top_k=3, title_block_rows=2_500)
    left = pa.table({"proposal_id": pa.array(range(len(queries)), pa.int64()), "query": pa.array(queries, pa.string())})
    right = pa.table({"title": pa.array(titles, pa.string()), "first_id": pa.array(range(len(titles)), pa.int64())})
    got = fuzzy._kernel(cfg)(left, right).to_pylist()
    assert len(seen) == 4 and all((a <= b).all() for a, b in zip(seen, seen[1:])) and seen[-1].max() > cfg.fuzzy_floor
    for i, q in enumerate(queries):
        mine = sorted((-r["score"], r["first_id"]) for r in got if r["proposal_id"] == i)
        scores = token_set_scores([q or ""] * len(titles), titles)
        every = sorted((-s, j) for j, s in enumerate(scores.tolist()) if s >= cfg.fuzzy_floor)[:3] if q else []
        assert [j for _, j in mine[:3]] == [j for _, j in every]
        assert all(-s >= -every[-1][0] for s, _ in mine)  # nothing below the third comes out


def test_every_title_may_have_its_own_floor():
    titles, queries = made(3, 2_600), made(4, 6)
    floors = np.array([0.0, 60.0, 75.0, 90.0, 100.0, 60.0])
    for n in (2_600, 300):
        found = TitleBlock(titles[:n], np.arange(n)).best(queries, 5, floors)
        for q, floor, (rows, scores) in zip(queries, floors, found):
            want = sorted((-token_set(q, t), i) for i, t in enumerate(titles[:n]))[:5]
            assert [(-s, i) for s, i in want if -s >= floor] == list(zip(scores.tolist(), rows.tolist()))


def test_shared_letters_are_never_too_few():
    rnd = random.Random(5)
    titles = ["".join(rnd.choice("abc é") for _ in range(rnd.randint(1, 40))) for _ in range(2_100)]
    titles[:9] = ["a" * 60 + " " + "b" * 60] * 9  # more than nearly all others have
    block = TitleBlock(titles, np.arange(len(titles)))
    for title in ("abc cab", "a" * 60, "é" * 300 + " " + "a" * 300, "zzz", "a"):
        bag = block.shared_letters(_Asked(block, title)).astype(int)
        for i, t in enumerate(titles[:300]):
            own = " ".join(sorted(set(t.split())))
            true = sum(min(own.count(c), " ".join(sorted(set(title.split()))).count(c)) for c in "abcé")
            assert bag[i] >= true and (bag[i] == true or max(map(title.count, "abcé")) > 10)
