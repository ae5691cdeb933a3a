"""Hot normal forms, very long titles, missing cells, the encoder of an index, reports on a store."""

import random
import tracemalloc
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from titlesieve.config import ScreeningConfig
from titlesieve.functions.encoders import HashingEncoder, ModelEncoder
from titlesieve.functions.lcs import length_bands, token_set_scores
from titlesieve.operators import blocks, exact, fuzzy
from titlesieve.plans import index, status
from titlesieve.plans.screen import IndexNotReady, load_library
from titlesieve.sources.sheets import MISSING_CELLS, open_sheet, read_sheet
from titlesieve.sources.store import TitleStore

HOT = ScreeningConfig(hot_form_rows=16)


def sides(spark, forms):
    """Rows of both sides as (form, how many left, how many right)."""
    left, right = [], []
    for form, m, n in forms:
        left += [(len(left) + i, form) for i in range(m)]
        right += [(len(right) + i, form, "active") for i in range(n)]
    return (spark.createDataFrame(left, "proposal_id long, normalized_title string"),
            spark.createDataFrame(right, "id long, normalized_title string, record_status string"), left, right)


def expected(left, right):
    ids = {}
    for i, form, _ in right:
        ids.setdefault(form, []).append(i)
    return sorted((p, i) for p, form in left if form is not None for i in ids.get(form, ()))


FORMS = [("", 120, 100), ("climate news", 40, 3), ("rare", 1, 70), ("cold", 2, 2), (None, 30, 30), ("left only", 50, 0),
         ("right only", 0, 50), *[(f"t{i}", 1, 1) for i in range(90)]]


@pytest.mark.parametrize("most", [100_000, 1])  # broadcast grid, joined grid
def test_hot_forms_keep_every_pair(spark, most):
    left, right, a, b = sides(spark, FORMS)
    cfg = ScreeningConfig(hot_form_rows=16, most_broadcast_forms=most)
    got = exact.exact_pairs(left, right, cfg)
    assert got.columns == ["normalized_title", "proposal_id", "id"]
    assert sorted((r["proposal_id"], r["id"]) for r in got.collect()) == expected(a, b)


def test_no_hot_form_and_empty_sides(spark):
    left, right, a, b = sides(spark, FORMS)
    assert sorted((r["proposal_id"], r["id"]) for r in exact.exact_pairs(left, right).collect()) == expected(a, b)
    assert exact.exact_pairs(left.limit(0), right, HOT).isEmpty() and exact.exact_pairs(left, right.limit(0), HOT).isEmpty()


def test_a_hot_form_spreads_over_the_tasks(spark):
    left, right, a, b = sides(spark, [("hot", 200, 200), *[(f"t{i}", 1, 1) for i in range(400)]])
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")

        def busiest(cfg):
            rows = exact.exact_pairs(left, right, cfg).groupBy(F.spark_partition_id()).count().collect()
            return max(r["count"] for r in rows) / sum(r["count"] for r in rows)

        assert busiest(ScreeningConfig()) > 0.9 and busiest(HOT) < 0.5
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_length_bands_are_bounded_and_whole():
    rnd = random.Random(4)
    titles = ["x" * rnd.choice([0, 3, 10, 40, 900]) for _ in range(500)] + ["y" * 20_000]
    bands = length_bands(titles, 10_000)
    assert sorted(i for b in bands for i in b) == list(range(501))
    assert all(len(b) == 1 or len(b) * max(len(titles[i]) for i in b) <= 10_000 for b in bands)
    assert len(length_bands(["a b", "c"], 10_000)) == 1 and length_bands([], 10_000) == []
    wide = ["".join(chr(0x4E00 + 20 * i + j) for j in range(20)) for i in range(200)]  # 4,000 letters
    assert max(map(len, length_bands(wide, 10_000))) <= 40_000 // 4_001


def hits(cfg, queries, titles):
    left = pa.table({"proposal_id": pa.array(range(len(queries)), pa.int64()), "query": pa.array(queries, pa.string())})
    right = pa.table({"title": pa.array(titles, pa.string()), "first_id": pa.array(range(len(titles)), pa.int64())})
    return fuzzy._kernel(cfg)(left, right).to_pylist()


def test_bands_do_not_change_the_best_titles():
    rnd = random.Random(8)
    words = "climate news daily weekly global sports Größe नया 新聞".split()
    titles = [" ".join(rnd.choice(words) for _ in range(rnd.choice([1, 2, 4, 30]))) + f" {i % 50}" for i in range(300)]
    queries = ["climate news 3", "global  sports weekly 12", "", "नया 新聞", *titles[:5]]
    cfg = ScreeningConfig(top_k=7, title_matrix_cells=500)
    got = hits(cfg, queries, titles)
    for q, query in enumerate(queries):
        scored = sorted((-s, i) for i, s in enumerate(token_set_scores([query] * len(titles), titles)) if s >= cfg.fuzzy_floor)
        mine = sorted((-r["score"], r["first_id"]) for r in got if r["proposal_id"] == q)[:cfg.top_k]
        assert [i for _, i in mine] == [i for _, i in scored[:cfg.top_k]]
        assert all(abs(a[0] - b[0]) < 1e-9 for a, b in zip(mine, scored))


def test_a_side_of_a_block_may_be_empty():
    assert hits(HOT, ["climate news"], []) == hits(HOT, [], ["climate news"]) == hits(HOT, [], []) == []


def test_a_title_of_a_million_characters():
    rnd = random.Random(2)
    words = [f"w{i}" for i in range(4_000)]
    long_one = " ".join(rnd.choice(words) for _ in range(190_000))
    titles = [f"climate news {i}" for i in range(2_000)] + [long_one[:1_000_000]]
    tracemalloc.start()
    got = hits(ScreeningConfig(top_k=3), ["climate news 77", "w5 w9"], titles)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200e6
    best = {q: max((r["score"], -r["first_id"]) for r in got if r["proposal_id"] == q) for q in (0, 1)}
    assert best == {0: (100.0, -77), 1: (100.0, -2_000)}


def test_long_titles_ask_for_more_blocks(spark):
    left = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "proposal_id long, query string, cluster_id int")
    right = spark.createDataFrame([("x" * 1000 + str(i), 0) for i in range(30)] + [(None, 0)], "title string, cluster_id int")
    row = blocks.grid(left, right, "cluster_id", 64, 100, blocks.Chars("query", "title", 5_000)).first()
    assert row["_right_blocks"] == 7 and row["_left_blocks"] <= 2
    assert blocks.grid(left, right, "cluster_id", 64, 100).first()["_right_blocks"] == 1


def test_missing_cells(spark, tmp_path):
    rows = [f"Title {i},{m},news, {m or 'NA'}" for i, m in enumerate(MISSING_CELLS)] + ["Nana,none,Nan,NA value"]
    path = tmp_path / "raw.csv"
    path.write_text("Titles,Description,Domain,Contact_Info\n" + "\n".join(rows) + "\n", encoding="utf-8")
    got = read_sheet(spark, str(path)).collect()
    kept = [r for r in got if r["titles"].startswith("Title")]
    assert len(kept) == len(MISSING_CELLS) and all(r["description"] is None for r in kept)
    assert all(r["contact_info"] is not None for r in kept)  # a space before it: not the spelling itself
    assert [tuple(r) for r in got if r["titles"] == "Nana"] == [("Nana", "none", "Nan", "NA value")]
    as_written = read_sheet(spark, str(path), missing=()).filter("description = 'n/a'").count()
    assert as_written == 1 and open_sheet(spark, str(path))[0].filter("description = 'n/a'").isEmpty()
    read_sheet(spark, str(path), missing=()).write.parquet(str(tmp_path / "p"))
    assert read_sheet(spark, str(tmp_path / "p"), "parquet").filter("description = 'n/a'").count() == 1


@pytest.fixture()
def store(spark, tmp_path):
    store = TitleStore(spark, str(tmp_path / "store"))
    titles = ["climate news", "sports weekly", "health digest", "global review", "tech today", "climate review"]
    store.replace("corpus", spark.createDataFrame(
        [(i + 1, t, t, "active") for i, t in enumerate(titles)], "id long, title string, normalized_title string, record_status string"))
    return store


CLUSTERED = ScreeningConfig(dimension=32, kmeans_restarts=1, kmeans_iterations=5, min_clusters=2)


def vectors_of(encoder, spark):
    asked = spark.createDataFrame([(1, "climate weekly"), (2, "unheard of")], "id long, text string")
    return {r["id"]: r["embedding"] for r in encoder.encode(asked, "text").collect()}


def test_an_index_brings_its_encoder(spark, store):
    with pytest.raises(IndexNotReady):
        index.load_encoder(store)
    _, fitted = index.build_index(store, HashingEncoder(32), CLUSTERED)
    again = index.load_encoder(TitleStore(spark, store.root))  # as after a restart
    assert again.dimension == 32 and vectors_of(again, spark) == vectors_of(fitted, spark)

    # records that come later change what a fit would give, not what the index was built with
    store.append("corpus", spark.createDataFrame([(i, "climate weekly", "climate weekly", "active") for i in range(7, 60)],
                                                 "id long, title string, normalized_title string, record_status string"))
    assert vectors_of(HashingEncoder(32).fit(index.texts(store.read("corpus")), "text"), spark) != vectors_of(fitted, spark)
    assert vectors_of(index.load_encoder(store), spark) == vectors_of(fitted, spark)
    assert index.build_clusters(store, HashingEncoder(16), CLUSTERED) == 59
    assert {len(r["centroid"]) for r in store.read("centroids").collect()} == {32}  # encoded as the index is
    index.rebuild_index(store, HashingEncoder(32), CLUSTERED)
    assert vectors_of(index.load_encoder(store), spark) != vectors_of(fitted, spark)
    assert load_library(store).dimension == 32


def test_a_plugged_in_encoder_must_be_that_of_the_index(spark, store):
    def make_predict():
        import numpy as np

        return lambda texts: np.array([[len(t), 1.0] for t in texts], dtype=np.float32)

    own = ModelEncoder(make_predict, 2, name="lengths")
    index.build_index(store, own, CLUSTERED)
    assert index.load_encoder(store, own) is own
    for wrong in (None, ModelEncoder(make_predict, 2, name="other"), ModelEncoder(make_predict, 3, name="lengths")):
        with pytest.raises(IndexNotReady):
            index.load_encoder(store, wrong)


def test_health_names_the_model_and_the_time(spark, store):
    before = status.store_health(store).first()
    assert before["status"] == "degraded" and before["embedding_model"] is None and before["vector_count"] == 0
    index.build_index(store, HashingEncoder(32), CLUSTERED)
    after = status.store_health(store).first()
    assert after["status"] == "healthy" and after["embedding_model"] == "hashing-tf-idf" and after["vector_count"] == 6
    assert after["checked_at"] is not None


def test_latencies_as_report_files(spark, tmp_path):
    timings = spark.createDataFrame([(float(i),) for i in Counter(range(1, 101))], "ms double")
    status.write_latencies(timings, "ms", str(tmp_path / "r"))
    for row in (spark.read.json(str(tmp_path / "r" / "json")).first(), spark.read.csv(str(tmp_path / "r" / "csv"), header=True).first()):
        assert int(row["query_count"]) == 100 and float(row["median_ms"]) == 50.5 and float(row["p95_ms"]) == 95.05
