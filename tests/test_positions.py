"""Source positions follow from the files, however they are cut, packed and read again."""

import gzip

import pytest
from pyspark.sql import functions as F

from titlesieve.config import ScreeningConfig
from titlesieve.plans import ingest
from titlesieve.sources.sheets import POSITION, read_positioned
from titlesieve.sources.store import TitleStore

# of very different sizes: a scan takes the large files first
SIZES = {"a": 3, "b": 700, "c": 1, "d": 90, "e": 0, "f": 300}
WANTED = [f"{name} {i}" for name in SIZES for i in range(SIZES[name])]


@pytest.fixture()
def folder(tmp_path):
    for name, n in SIZES.items():
        lines = ["Titles,description,domain,contact_info", *[f"{name} {i},{'x' * (i % 40)},news," for i in range(n)]]
        (tmp_path / f"{name}.csv").write_text("\n".join(lines) + "\n")
    return str(tmp_path)


@pytest.fixture()
def split_size(spark):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}

    def set_to(size, cost=0):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", str(cost))

    yield set_to
    for k, v in kept.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("size", [500, 4_000, 1 << 27])
def test_positions_do_not_depend_on_splits(spark, folder, split_size, size):
    split_size(size)
    for _ in range(2):
        rows = read_positioned(spark, folder)
        got = sorted((r[POSITION], r["titles"]) for r in rows.collect())
        assert got == list(enumerate(WANTED))
    if size == 500:
        assert spark.read.csv(folder).rdd.getNumPartitions() > 20


def test_ingested_rows_are_numbered_as_in_the_files(spark, folder, split_size):
    store = TitleStore(spark, f"{folder}/store")
    split_size(800)
    cfg = ScreeningConfig(min_valid_titles=5)
    ingest.run_ingestion(store, read_positioned(spark, f"{folder}/*.csv"), "folder", cfg=cfg)
    rows = store.read("corpus").orderBy("id").collect()
    assert [r["title"] for r in rows] == WANTED
    assert [(r["id"], r["source_row_number"]) for r in rows] == [(i + 1, i + 2) for i in range(len(WANTED))]


def test_compressed_parquet_empty_and_clashing(spark, tmp_path):
    with gzip.open(tmp_path / "z.csv.gz", "wt") as f:
        f.write("titles,_metadata\n" + "".join(f"t{i},m\n" for i in range(50)))
    rows = read_positioned(spark, str(tmp_path / "z.csv.gz"))
    assert rows.columns == ["titles", "_metadata", POSITION]
    assert all(r["titles"] == f"t{r[POSITION]}" and r["_metadata"] == "m" for r in rows.collect())
    spark.range(100).select(F.col("id").cast("string").alias("titles")).coalesce(1).write.parquet(str(tmp_path / "p"))
    assert all(int(r["titles"]) == r[POSITION] for r in read_positioned(spark, str(tmp_path / "p"), "parquet").collect())
    (tmp_path / "none.csv").write_text("titles\n")
    assert read_positioned(spark, str(tmp_path / "none.csv")).isEmpty()
