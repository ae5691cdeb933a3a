import pytest
from brute import screen_one, submit_one_by_one
from fixtures import frames, make

from titlesieve.config import ScreeningConfig
from titlesieve.plans.screen import screen
from titlesieve.plans.submit import submit

# small caps and blocks, so that quotas, several blocks and several cells all occur
TIGHT = ScreeningConfig(top_k=4, corpus_block_rows=20, proposal_block_rows=7, title_block_rows=16, small_batch_rows=0)
# the same caps for a batch that is sent to the scans
SCANNED = ScreeningConfig(top_k=4, title_block_rows=16)


def spark_verdicts(spark, data, cfg):
    library, proposals = frames(spark, data)
    return {r["proposal_id"]: r for r in screen(proposals, library, cfg).collect()}


def as_plain(r):
    return {
        "decision": r["decision"], "risk": r["risk"], "final_score": r["final_score"], "reasons": r["reasons"],
        "explanation": r["explanation"], "candidate_count": r["candidate_count"],
        "matches": [(m["id"], m["semantic_score"], m["lexical_score"], m["phonetic_score"], m["final_score"])
                    for m in r["top_matches"]],
    }


@pytest.mark.parametrize("seed,cfg", [(1, ScreeningConfig()), (2, TIGHT), (3, TIGHT), (3, SCANNED)])
def test_verdicts_equal_one_at_a_time_screening(spark, seed, cfg):
    data = make(seed)
    got = spark_verdicts(spark, data, cfg)
    corpus, vectors, centroids, proposals = data
    assert len(got) == len(proposals)
    for p in proposals:
        assert as_plain(got[p["proposal_id"]]) == screen_one(p, corpus, vectors, centroids, cfg), p


def test_without_clusters_the_fallback_scope_is_used(spark):
    corpus, vectors, _, proposals = make(4)
    cfg = ScreeningConfig(top_k=4, fallback_rows=30)
    got = spark_verdicts(spark, (corpus, vectors, [], proposals), cfg)
    for p in proposals:
        assert as_plain(got[p["proposal_id"]]) == screen_one(p, corpus, vectors, [], cfg), p


def test_no_candidates(spark):
    corpus, vectors, centroids, proposals = make(5, records=12)
    for r in corpus:
        r["record_status"] = "rejected"
    got = spark_verdicts(spark, (corpus, vectors, centroids, proposals), ScreeningConfig())
    for r in got.values():
        assert (r["decision"], r["final_score"], r["candidate_count"]) == ("NO_STRONG_CONFLICT", 0.0, 0)
        assert r["top_matches"] == [] and r["reasons"] == ["No candidate matches found in dataset"]
        assert r["score_breakdown"]["weights_used"]["semantic"] == 0.625


@pytest.mark.parametrize("seed", [6, 7])
def test_submissions_equal_sequential_intake(spark, seed):
    corpus, vectors, centroids, proposals = make(seed, records=60, asked=60, hot=0.2)
    # high bar, so that plenty of proposals are approved and repeated titles meet them
    cfg = ScreeningConfig(conflict_threshold=0.97, review_threshold=0.95)
    fresh = ["Entirely Unseen Title", "entirely unseen TITLE", "Other Fresh Words"]
    for n, p in enumerate(proposals):
        if n % 4 == 0:
            p["title"] = fresh[n // 4 % 3]
    # rows with an empty normal form only change the candidate count of later ones; kept apart here
    proposals = [p for p in proposals if any(c.isascii() and c.isalnum() for c in p["title"])]
    library, asked = frames(spark, (corpus, vectors, centroids, proposals))
    done = submit(asked, library, cfg)
    got = {r["proposal_id"]: r for r in done.results.collect()}
    want = submit_one_by_one(proposals, corpus, vectors, centroids, cfg)
    assert any(v["reasons"][0].startswith("Exact") and v["candidate_count"] > 0 for v in want)
    for v in want:
        r = got[v["proposal_id"]]
        assert {**as_plain(r), "submission_id": r["submission_id"], "record_status": r["record_status"],
                "proposal_id": r["proposal_id"]} == v
    assert {r["id"] for r in done.records.select("id").collect()} == {v["submission_id"] for v in want}
