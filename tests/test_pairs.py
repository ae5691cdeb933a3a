"""The whole candidate union: every exact pair, none of them shuffled."""

import pytest
from brute import candidates
from fixtures import frames, make
from pyspark.sql import functions as F
from test_derived import shuffled

from titlesieve.config import ScreeningConfig
from titlesieve.plans.screen import all_candidates, prepare_proposals

CFG = ScreeningConfig(top_k=4, hot_form_rows=32)


def found(spark, data, cfg=CFG):
    library, proposals = frames(spark, data)
    return all_candidates(prepare_proposals(proposals, library, cfg), library, cfg)


@pytest.mark.parametrize("seed", [31])
def test_all_candidates_equal_one_at_a_time_retrieval(spark, seed):
    data = make(seed, asked=30)
    corpus, vectors, centroids, asked = data
    got = found(spark, data).collect()
    assert len({(r["proposal_id"], r["id"]) for r in got}) == len(got)
    exact = {(r["proposal_id"], r["id"]) for r in got if r["by_exact"]}
    for p in asked:
        expected, _ = candidates(p, corpus, vectors, centroids, CFG)
        mine = {r["id"]: r for r in got if r["proposal_id"] == p["proposal_id"]}
        assert set(mine) == {r["id"] for r, _ in expected}
        for record, similarity in expected:
            row = mine[record["id"]]
            assert abs(row["raw_similarity"] - similarity) < 1e-6  # vectors are made unit vectors again
            assert row["by_exact"] == (row["normalized_title"] == row["q_normalized"]) == ("exact" in row["sources"])
            assert row["cluster_id"] == record["cluster_id"] and row["by_semantic"] == ("semantic" in row["sources"])
    assert any("semantic" in r["sources"] for r in got if r["by_exact"]) and exact


def test_repeated_keys_list_every_combination_once(spark):
    corpus, vectors, centroids, asked = make(33, asked=12)
    library, proposals = frames(spark, (corpus + corpus[:40], vectors, centroids, asked + asked[:4]))
    rows = all_candidates(prepare_proposals(proposals, library, CFG), library, CFG)
    of_proposal, of_record = ({k: 1 + (k in twice) for k in every} for twice, every in (
        ({p["proposal_id"] for p in asked[:4]}, [p["proposal_id"] for p in asked]),
        ({r["id"] for r in corpus[:40]}, [r["id"] for r in corpus])))
    for r in rows.filter("by_exact").groupBy("proposal_id", "id").count().collect():
        assert r["count"] == of_proposal[r["proposal_id"]] * of_record[r["id"]]


def test_exact_pairs_are_not_shuffled(spark):
    df = found(spark, make(34, records=1000, asked=400, hot=1.0), ScreeningConfig(top_k=2, hot_form_rows=256))
    pairs = df.filter(F.col("by_exact")).count()
    assert pairs > 50_000 and shuffled(df) < pairs / 2
