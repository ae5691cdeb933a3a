import uuid

import pytest
from fixtures import frames, make
from pyspark.sql import functions as F

from titlesieve.config import ScreeningConfig
from titlesieve.functions.encoders import HashingEncoder, ModelEncoder
from titlesieve.plans import index, ingest, status
from titlesieve.plans.requests import split_requests
from titlesieve.plans.screen import IndexNotReady, Library, load_library, prepare_proposals, screen
from titlesieve.plans.submit import submit
from titlesieve.plans.validate import validate_dataset
from titlesieve.sources import schemas
from titlesieve.sources.sheets import read_sheet
from titlesieve.sources.store import TitleStore
from titlesieve.streaming import intake

SMALL = ScreeningConfig(min_valid_titles=5, dimension=32, kmeans_restarts=1, kmeans_iterations=5, min_clusters=2)


@pytest.fixture()
def folder(tmp_path):
    return str(tmp_path)


def sheet_file(folder, rows, header=" Titles ,DESCRIPTION,domain,contact_info"):
    path = f"{folder}/{uuid.uuid4().hex}.csv"
    with open(path, "w", encoding="utf-8") as f:
        f.write("\n".join([header, *rows]) + "\n")
    return path


ROWS = ["Climate News,about climate,news - sports,a@b.c", "climate   NEWS!,,News - Sports,", "nan,x,business,", ",y,,",
        "Größe Daily,nan,, z ", '"Tech, Weekly",d,technology,', "Health,d,health,", "Science,d,science,", "समाचार,d,news,"]


def test_headers_are_cleaned(spark, folder):
    assert read_sheet(spark, sheet_file(folder, ROWS)).columns == list(schemas.RAW_COLUMNS)


def test_validation_report(spark, folder):
    report = validate_dataset(spark, sheet_file(folder, ROWS), cfg=SMALL, report_folder=f"{folder}/report").first()
    assert report["is_valid"] and report["errors"] == []
    assert (report["total_rows"], report["valid_titles_count"], report["blank_titles_count"]) == (9, 7, 2)
    assert report["duplicate_raw_titles_count"] == 0 and report["duplicate_normalized_titles_count"] == 1
    assert report["domain_counts"]["news-sports"] == 2 and report["domain_counts"]["unknown"] == 2
    assert report["empty_domains_count"] == 2 and report["missing_descriptions_count"] == 2
    assert (report["min_title_length"], report["max_title_length"]) == (6, 15)
    assert spark.read.json(f"{folder}/report/json").first()["total_rows"] == 9
    assert spark.read.csv(f"{folder}/report/csv", header=True).first()["errors"] == "[]"


def test_validation_ends_early(spark, folder):
    gone = validate_dataset(spark, f"{folder}/none.csv").first()
    assert not gone["file_exists"] and not gone["is_valid"] and gone["errors"][0].startswith("Dataset file not found")
    odd = validate_dataset(spark, sheet_file(folder, ["x,y"], "titles,other"), report_folder=f"{folder}/r").first()
    assert odd["sheet_exists"] and not odd["columns_valid"] and "Missing required columns" in odd["errors"][0]
    few = validate_dataset(spark, sheet_file(folder, ROWS)).first()
    assert few["columns_valid"] and not few["is_valid"] and "less than required minimum (6000)" in few["errors"][0]


def test_ingestion_keeps_the_counts_of_every_domain(spark, folder):
    store, few = TitleStore(spark, f"{folder}/store"), ScreeningConfig(min_valid_titles=5, max_map_entries=2)
    raw = read_sheet(spark, sheet_file(folder, ROWS))
    for _ in range(2):
        ingest.run_ingestion(store, raw, "sheet.csv", cfg=few)
    audits = ingest.latest_audits(store.read("ingestions")).orderBy("id").collect()
    want = {(r["domain"], r["rows"]) for r in ingest.domain_counts(raw).collect()}
    assert len(want) > 2
    for audit in audits:
        assert audit["domain_counts_json"] is None
        kept = store.read(audit["domain_counts_table"]).filter(F.col("ingestion_id") == audit["id"]).collect()
        assert {(r["domain"], r["rows"]) for r in kept} == want and len(kept) == len(want)


def test_ingestion_index_clusters_and_screening(spark, folder):
    store = TitleStore(spark, f"{folder}/store")
    raw = read_sheet(spark, sheet_file(folder, ROWS))
    with pytest.raises(ValueError):
        ingest.run_ingestion(store, raw, "sheet.csv")
    done = ingest.run_ingestion(store, raw, "sheet.csv", cfg=SMALL)
    assert done == {"audit_id": 1, "inserted_count": 7, "total_rows": 9, "status": "completed"}
    rows = store.read("corpus").orderBy("id").collect()
    assert [r["id"] for r in rows] == list(range(1, 8))
    assert [r["source_row_number"] for r in rows] == [2, 3, 6, 7, 8, 9, 10]
    assert rows[0]["domain"] == "news-sports" and rows[2]["description"] is None and rows[2]["contact_info"] == "z"
    assert rows[0]["phonetic_code"] == rows[1]["phonetic_code"] == "KLMT NS" and rows[6]["phonetic_code"] is None
    state = ingest.latest_audits(store.read("ingestions")).first()
    assert state["status"] == "completed" and state["valid_rows"] == 7 and state["invalid_rows"] == 2

    again = ingest.run_ingestion(store, raw, "sheet.csv", force_clear=False, cfg=SMALL)
    assert again["audit_id"] == 2 and store.read("corpus").count() == 14
    assert store.read("corpus").agg(F.max("id")).first()[0] == 14
    ingest.run_ingestion(store, raw, "sheet.csv", cfg=SMALL)
    assert store.read("corpus").count() == 7

    count, encoder = index.build_index(store, HashingEncoder(32), SMALL)
    assert count == 7 and [r["position"] for r in store.read("corpus").orderBy("id").collect()] == list(range(7))
    assert index.build_clusters(store, HashingEncoder(32), SMALL) == 7
    assert store.read("corpus").filter("cluster_id is null").isEmpty()
    meta = store.read("cluster_meta").first()
    assert sum(meta["cluster_sizes"].values()) == 7 == meta["record_count"]
    health = status.index_health(store.read("corpus"), store.read("vectors"), store.read("centroids")).first()
    assert health["status"] == "healthy" and health["orphan_vectors"] == 0 and health["cluster_count"] == meta["n_clusters"]

    # every record finds itself first, from a saved and reloaded encoder
    encoder.save(f"{folder}/encoder")
    loaded = HashingEncoder.load(f"{folder}/encoder", 32)
    library = load_library(store)
    asked = loaded.encode(index.texts(library.corpus).join(library.corpus.select("id", "title", "domain"), "id"), "text")
    got = screen(asked.withColumnRenamed("id", "proposal_id"), library, SMALL).collect()
    assert all(r["proposal_id"] in [m["id"] for m in r["top_matches"]] for r in got)
    assert index.rebuild_index(store, encoder, SMALL) == 7


def test_empty_corpus_is_not_indexed(spark, folder):
    store = TitleStore(spark, f"{folder}/empty")
    assert index.build_index(store, HashingEncoder(8))[0] == 0 and index.build_clusters(store, HashingEncoder(8)) == 0
    assert not store.exists("vectors")
    assert index.rebuild_index(store, HashingEncoder(8)) == 0
    with pytest.raises(IndexNotReady):
        load_library(store)
    store.replace("vectors", spark.createDataFrame([(1, 0, [1.0])], schemas.VECTORS))
    with pytest.raises(IndexNotReady):
        load_library(store)
    asked = spark.createDataFrame([], schemas.PROPOSALS)
    with pytest.raises(IndexNotReady):
        prepare_proposals(asked, Library(store.read("corpus"), store.read("vectors").limit(0)), SMALL)


def test_encoders(spark):
    df = spark.createDataFrame([(1, "climate news"), (2, "  "), (3, None)], "id long, text string")

    def make_predict():
        import numpy as np

        return lambda texts: np.array([[len(t), 1.0, 0.0] for t in texts], dtype=np.float32)

    got = {r["id"]: r["embedding"] for r in ModelEncoder(make_predict, 3).encode(df, "text").collect()}
    assert abs(sum(x * x for x in got[1]) - 1) < 1e-6 and got[2] == got[3] == [0.0, 0.0, 0.0]
    built = HashingEncoder(16).fit(df, "text").encode(df, "text").collect()
    assert [len(r["embedding"]) for r in built] == [16] * 3 and not any(built[1]["embedding"])


def test_request_limits(spark):
    rows = [(1, "t" * 501, None, None, None, None), (2, "", "d" * 201, None, None, None), (3, " ", None, "l" * 51, None, None),
            (4, "ok", None, None, "x" * 2000, "c" * 500), (5, None, None, None, "x" * 2001, "c" * 501)]
    good, bad = split_requests(spark.createDataFrame(
        rows, "proposal_id long, title string, domain string, language string, description string, contact_info string"))
    row = good.first()
    assert good.count() == 1 and (row["domain"], row["language"]) == ("general", "English")
    assert {r["proposal_id"]: len(r["violations"]) for r in bad.collect()} == {1: 1, 2: 2, 3: 1, 5: 3}


def test_stream_equals_batches_and_survives_replay(spark, folder):
    corpus, vectors, centroids, proposals = make(31, records=50, asked=40, hot=0.2)
    cfg = ScreeningConfig(conflict_threshold=0.97, review_threshold=0.95)
    for n, p in enumerate(proposals):
        if n % 5 == 0:
            p["title"] = "Entirely Unseen Title"
    library, asked = frames(spark, (corpus, vectors, centroids, proposals))
    for part, low in ((0, 0), (1, 20)):
        asked.filter(F.col("seq").between(low + 1, low + 20)).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    query = intake.screen_stream(
        intake.read_proposals(spark, f"{folder}/in", files_per_batch=1), library, f"{folder}/out", f"{folder}/state",
        cfg, availableNow=True)
    query.awaitTermination()
    streamed = {r["proposal_id"]: (r["submission_id"], r["record_status"], r["candidate_count"])
                for r in spark.read.parquet(f"{folder}/out/results").collect()}
    whole = {r["proposal_id"]: (r["submission_id"], r["record_status"], r["candidate_count"])
             for r in submit(asked, library, cfg).results.collect()}
    assert {k: v[1] for k, v in streamed.items()} == {k: v[1] for k, v in whole.items()}
    assert sorted(v[0] for v in streamed.values()) == sorted(v[0] for v in whole.values())
    assert sum(v[1] == "approved" for v in streamed.values()) >= 1

    # the last micro-batch once more: nothing changes, its own rows are not seen
    last = spark.read.parquet(f"{folder}/out/results").agg(F.max("batch_id")).first()[0]
    mine = [r["proposal_id"] for r in
            spark.read.parquet(f"{folder}/out/results").filter(F.col("batch_id") == last).collect()]
    intake.screen_batch(asked.filter(F.col("proposal_id").isin(mine)), last, library, f"{folder}/out", cfg)
    replayed = {r["proposal_id"]: (r["submission_id"], r["record_status"], r["candidate_count"])
                for r in spark.read.parquet(f"{folder}/out/results").collect()}
    assert replayed == streamed
