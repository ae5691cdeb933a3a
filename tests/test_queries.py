"""Every registered query next to its SQL on the smallest supplied tables."""

import os

import pytest

from checks.compare import TABLES, canonical
from checks.entries import ENTRIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="supplied tables are absent")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(ENTRIES))
def test_query(spark, duck, name):
    entry = ENTRIES[name]
    df = entry.run(spark, FOLDER)
    columns = sorted(df.columns)
    got = canonical([tuple(r) for r in df.select(*columns).collect()])
    if entry.oracle is None:
        assert got
        return
    result = duck.execute(entry.oracle)
    have = [d[0] for d in result.description]
    assert sorted(have) == columns
    order = [have.index(c) for c in columns]
    assert got == canonical([tuple(r[i] for i in order) for r in result.fetchall()])


def test_no_pair_explosion_in_plans(spark):
    """No cartesian product or nested-loop join in the retrieval of a screening."""
    from checks import views
    from titlesieve.config import ScreeningConfig
    from titlesieve.plans.screen import prepare_proposals, ranked_candidates

    cfg = ScreeningConfig()
    library = views.library(spark, FOLDER)
    prepared = prepare_proposals(views.proposals(spark, FOLDER), library, cfg)
    plan = ranked_candidates(prepared, library, cfg)[0]._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "WindowGroupLimit" in plan and "FlatMapCoGroupsInArrow" in plan


def test_registered_clusters_use_the_default_settings(monkeypatch):
    from checks import entries
    from titlesieve.config import ScreeningConfig

    seen = []
    monkeypatch.setattr(entries.views, "vectors", lambda spark, sf: None)
    monkeypatch.setattr(entries.clusters, "fit_clusters", lambda rows, cfg: (seen.append(cfg), None))
    monkeypatch.setattr(entries.clusters, "cluster_sizes", lambda assigned: assigned)
    entries.fitted_clusters(None, "")
    assert seen == [ScreeningConfig()]
