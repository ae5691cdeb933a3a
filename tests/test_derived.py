"""Screening from derived tables: the same verdicts, and nothing of the corpus's size in an exchange."""

import re
import uuid

import pytest
from brute import screen_one
from fixtures import frames, make
from pyspark.sql import functions as F

from titlesieve.config import ScreeningConfig
from titlesieve.operators import bloom, exact
from titlesieve.plans import derived
from titlesieve.plans.screen import is_small, load_library, prepare_proposals, ranked_candidates, screen, verify
from titlesieve.plans.submit import submit
from titlesieve.sources import schemas
from titlesieve.sources.store import TitleStore

CFG = ScreeningConfig(top_k=4, head_buckets=8)
LARGE = ScreeningConfig(top_k=4, head_buckets=8, small_batch_rows=0, title_block_rows=16, corpus_block_rows=20)


def stored(spark, folder, data, parts=1, cfg=CFG):
    """A store whose corpus came in ``parts`` appends."""
    library, proposals = frames(spark, data)
    store = TitleStore(spark, f"{folder}/{uuid.uuid4().hex}")
    store.replace("vectors", library.vectors)
    store.replace("index_meta", spark.createDataFrame([("m", 8, library.vectors.count(), None, {})], schemas.INDEX_META))
    store.replace("centroids", library.centroids)
    store.replace("corpus", library.corpus.limit(0))
    for i in range(parts):
        derived.append_records(store, library.corpus.filter(F.col("id") % parts == i), cfg)
    return store, proposals


def plain(r):
    return {
        "decision": r["decision"], "risk": r["risk"], "final_score": r["final_score"], "reasons": r["reasons"],
        "explanation": r["explanation"], "candidate_count": r["candidate_count"],
        "matches": [(m["id"], m["semantic_score"], m["lexical_score"], m["phonetic_score"], m["final_score"]) for m in r["top_matches"]],
    }


@pytest.mark.parametrize("seed, parts, cfg", [(11, 1, CFG), (12, 4, CFG), (12, 4, LARGE)])
def test_verdicts_from_appended_parts(spark, tmp_path, seed, parts, cfg):
    data = make(seed)
    store, proposals = stored(spark, tmp_path, data, parts)
    library = load_library(store)
    assert library.heads is not None and library.largest_id == 140 and store.read("appends").count() == parts
    got = {r["proposal_id"]: plain(r) for r in screen(proposals, library, cfg).collect()}
    corpus, vectors, centroids, asked = data
    for p in asked:
        assert got[p["proposal_id"]] == screen_one(p, corpus, vectors, centroids, cfg), p


def test_outdated_tables_are_left_aside(spark, tmp_path):
    store, proposals = stored(spark, tmp_path, make(13, records=30, asked=5))
    assert load_library(store).titles is not None
    extra = store.read("corpus").limit(1).withColumn("id", F.lit(900).cast("long"))
    # a broken append: its partial rows are there, its last row is not
    derived._write(store, extra, "broken", CFG, store.append)
    heads = load_library(store).heads
    assert heads is not None and heads.filter(F.array_contains("exact_ids", 900)).isEmpty()
    store.append("corpus", extra)  # past the derived tables
    assert derived.read_derived(store) is None and load_library(store).heads is None
    derived.build_derived(store, CFG)
    assert load_library(store).largest_id == 900 and store.read("appends").count() == 1
    store.replace("corpus", store.read("corpus").limit(31))  # as many rows, another version
    assert derived.read_derived(store) is None


def test_many_appends_are_built_anew(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(derived, "MOST_APPENDS", 2)
    store, _ = stored(spark, tmp_path, make(14, records=20, asked=5), parts=4)
    assert store.read("appends").count() <= 2 and load_library(store).heads is not None
    total = store.read("heads").agg(F.sum("exact_total")).first()[0]
    assert total == exact.usable(store.read("corpus")).count()


def test_submissions_append_behind_the_largest_id(spark, tmp_path):
    data = make(15, records=40, asked=10)
    store, proposals = stored(spark, tmp_path, data)
    done = submit(proposals, load_library(store), CFG)
    ids = sorted(r["id"] for r in done.records.collect())
    assert ids == list(range(41, 41 + len(ids)))
    assert derived.append_records(store, done.records, CFG) == len(ids)
    after = load_library(store)
    assert after.largest_id == ids[-1]
    again = {r["proposal_id"]: r for r in screen(proposals, after, CFG).collect()}
    approved = {r["title"] for r in done.records.filter("record_status = 'approved' and normalized_title <> ''").collect()}
    assert all("Exact normalized title match found" in again[p["proposal_id"]]["reasons"] for p in data[3] if p["title"] in approved)


def test_limits_and_defaults_hold_for_screening(spark, tmp_path):
    store, proposals = stored(spark, tmp_path, make(16, records=20, asked=8))
    x = F.col("embedding")
    odd = proposals.withColumn("embedding", F.when(F.col("seq") == 1, None).when(F.col("seq") == 2, F.slice(x, 1, 3)).when(
        F.col("seq") == 3, F.transform(x, lambda v: v * float("nan"))).otherwise(x))
    odd = odd.withColumn("title", F.when(F.col("seq") == 4, F.repeat(F.lit("t"), 501)).when(F.col("seq") == 5, "").otherwise(F.col("title")))
    odd = odd.withColumn("domain", F.lit(None).cast("string"))
    verdicts, rejected = verify(odd, load_library(store), CFG)
    got = verdicts.collect()
    assert {r["proposal_id"] for r in got} == {6, 7, 8} and {r["proposal_id"] for r in rejected.collect()} == {1, 2, 3, 4, 5}
    general = screen(odd.filter("seq > 5").withColumn("domain", F.lit("general")), load_library(store), CFG).collect()
    assert sorted(map(plain, got), key=str) == sorted(map(plain, general), key=str)


def test_bloom_filter_misses_no_key(spark):
    keys = spark.range(0, 3000).select(F.when(F.col("id") > 0, F.concat(F.lit("k"), F.col("id"))).alias("k"))
    sieve = bloom.build(keys, "k", 3000, 16, 1 << 20)
    asked = spark.range(0, 60_000).select(F.when(F.col("id") > 0, F.concat(F.lit("k"), F.col("id"))).alias("k"))
    passed = asked.filter(sieve.may_hold(F.col("k")))
    assert passed.join(keys, "k").count() == 2999 and passed.count() < 2999 + 600
    assert bloom.build(keys, "k", 3000, 16, 1 << 14) is None
    assert spark.range(5).filter(bloom.build(spark.range(0), "id", 0, 16, 1 << 20).may_hold(F.col("id"))).count() == 0


def shuffled(df):
    """Rows written to exchanges while ``df`` is collected, by the metrics of its plan."""
    df.collect()
    total, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            todo.append(node.executedPlan())
        elif "QueryStage" in name:
            todo.append(node.plan())
        if name == "Exchange":
            written = node.metrics().get("shuffleRecordsWritten")
            total += written.get().value()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return total


def test_a_small_batch_shuffles_nothing_of_the_corpus(spark, tmp_path):
    corpus, vectors, centroids, asked = make(17, records=100, asked=20)
    written = {}
    for times in (1, 10):
        many = [{**r, "id": r["id"] + 1000 * k, "title": r["title"] + (f" {k} x{r['id']}" if k else "")} for k in range(times) for r in corpus]
        spread = {i + 1000 * k: v for k in range(times) for i, v in vectors.items()}
        store, proposals = stored(spark, tmp_path, (many, spread, centroids, asked))
        library = load_library(store)
        prepared = prepare_proposals(proposals, library, CFG)
        assert is_small(prepared, CFG)
        written[times] = shuffled(ranked_candidates(prepared, library, CFG, True)[0])
        plan = ranked_candidates(prepared, library, CFG, True)[0]._jdf.queryExecution().executedPlan().toString()
        assert "FlatMapCoGroupsInArrow" not in plan and re.search(r"PartitionFilters: \[[^\]]*cluster_id", plan)
        assert exact.title_heads(library.corpus, 5).count() > 0
    assert 0 < written[10] < 2 * written[1] and written[10] < 200 * len(asked)
