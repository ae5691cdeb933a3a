"""Headline queries on ``local[$BENCH_CPUS]`` at ``$BENCH_SF_DIR``; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parent
sys.path.insert(0, str(ROOT))

from checks import views  # noqa: E402
from checks.entries import ENTRIES  # noqa: E402
from titlesieve.config import ScreeningConfig  # noqa: E402
from titlesieve.plans.screen import load_library, screen  # noqa: E402
from titlesieve.session import build_session  # noqa: E402

HEADLINE = ("exact_heads", "nearest_neighbours", "fuzzy_matches", "candidates", "lexical_scores", "dataset_report",
            "ingested_records", "index_positions", "corpus_statistics", "latency_summary")


def drain(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", master=f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": str(2 * int(cpus)),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
    })
    spark.sparkContext.setLogLevel("ERROR")
    # warm-up on the smallest data: starts the JVM's compiler and the Python workers
    small = str(Path(folder).parent / "sf0.001")
    drain(screen(views.proposals(spark, small), views.library(spark, small), ScreeningConfig()))

    seconds: dict[str, float] = {}

    def timed(name, run):
        start = time.perf_counter()
        run()
        seconds[name] = round(time.perf_counter() - start, 3)

    timed("build_library", lambda: views.library(spark, folder))
    asked = views.proposals(spark, folder)
    library = views.library(spark, folder)
    timed("screen", lambda: drain(screen(asked, library, ScreeningConfig())))
    # a stored library with derived tables, and batches of few proposals against it
    small_store = views.store_of(spark, folder)
    for n in (1, 100):
        few = asked.orderBy("proposal_id").limit(n)
        timed(f"screen_{n}", lambda: drain(screen(few, load_library(small_store), ScreeningConfig())))
    for name in HEADLINE:
        timed(name, lambda: drain(ENTRIES[name].run(spark, folder)))
    proposals = asked.count()
    print(json.dumps({
        "metric": "headline_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": Path(folder).name.removeprefix("sf"),
        "proposals": proposals,
        "proposals_per_sec": round(proposals / seconds["screen"], 1),
    }), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
