import numpy as np
import pytest
from brute import token_set
from fixtures import frames, make, unit_rows
from pyspark.sql import functions as F

from titlesieve.config import ScreeningConfig
from titlesieve.operators import clusters, exact, fuzzy, knn
from titlesieve.operators.ordinal import with_ordinal
from titlesieve.plans.screen import prepare_proposals


def test_weights_must_sum_to_one():
    with pytest.raises(ValueError):
        ScreeningConfig(semantic_weight=0.9)


@pytest.mark.parametrize("buckets", [1, 3, 16])
def test_ordinals_are_dense_and_ordered(spark, buckets):
    rows = spark.range(0, 997).select((F.col("id") * 7 - 300).alias("k")).repartition(5)
    got = with_ordinal(rows, "k", "n", start=10, buckets=buckets).orderBy("k").collect()
    assert [r["n"] for r in got] == list(range(10, 1007))


@pytest.mark.parametrize("seed", [11, 12])
def test_pruned_search_equals_plain_search(spark, seed):
    cfg = ScreeningConfig(corpus_block_rows=40, proposal_block_rows=8)
    library, proposals = frames(spark, make(seed, records=300, dimension=3))
    prepared = prepare_proposals(proposals, library, cfg)
    _, model = clusters.load_model(library.centroids, cfg)
    plain = knn.nearest_neighbours(prepared, library.vectors, 9, cfg).collect()
    pruned = knn.nearest_neighbours(prepared, library.vectors, 9, cfg, model, prune_from=0).collect()
    assert sorted(plain) == sorted(pruned) and len(plain) == 9 * prepared.count()


def test_pruning_skips_cells(spark):
    """Tight, well separated groups: after its own cell a proposal needs no other."""
    import numpy as np

    gen = np.random.default_rng(1)
    centres = np.eye(4, dtype=np.float32)
    points = unit_rows(np.repeat(centres, 50, axis=0) + 0.02 * gen.normal(size=(200, 4)))
    celled = knn.assign_cells(
        spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(points)], "id long, embedding array<float>"),
        centres, 1)
    stats = celled.groupBy("cell").agg(
        F.count("*").alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high")).orderBy("cell").collect()
    assert [r["n"] for r in stats] == [50] * 4
    cells = knn.Cells(knn._unit_rows(centres), 1, stats)
    bound = cells.ceilings(points[:1])
    assert bound[0, 0] > 0.99 and (bound[0, 1:] < 0.2).all()
    assert cells.opening(bound, 50).tolist() == [[True, False, False, False]]


def test_zero_vectors_have_their_own_cell(spark):
    rows = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0])], "id long, embedding array<float>")
    got = knn.assign_cells(rows, unit_rows([[1.0, 0.0]]), 4).orderBy("id").collect()
    assert [r["cell"] for r in got] == [-1, 0]


def test_one_title_holding_a_third_of_the_rows(spark):
    """The exact pass stays one row per proposal however often a title occurs."""
    rows = spark.range(3000).select(
        "id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), "id")).alias("normalized_title"),
        F.lit("active").alias("record_status"))
    asked = spark.range(300).select(F.col("id").alias("proposal_id"), F.lit("hot").alias("normalized_title"))
    heads = exact.exact_heads(asked, rows, 5).collect()
    assert len(heads) == 300
    assert all(r["exact_total"] == 1000 and r["exact_ids"] == [0, 3, 6, 9, 12] for r in heads)
    plan = exact.title_heads(rows, 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2 and "CartesianProduct" not in plan


def test_titles_shared_by_clusters(spark):
    """The last record of a title in any probed cluster stands for it, at the first one's place."""
    cfg = ScreeningConfig(top_k=3, title_block_rows=2)
    rows = [(1, "alpha news", 0), (2, "beta news", 1), (3, "alpha news", 1), (4, "gamma news", 0), (5, "news", 1),
            (6, "alpha news", 2)]
    corpus = spark.createDataFrame(rows, "id long, title string, cluster_id int").withColumn("record_status", F.lit("active"))
    asked = spark.createDataFrame([(1, "alpha news today", [0, 1])], "proposal_id long, title string, cluster_ids array<int>")
    got = fuzzy.fuzzy_hits(*fuzzy.scope(asked, corpus, cfg, True), cfg).orderBy("lex_rank").collect()
    titles = ["alpha news", "beta news", "gamma news", "news"]
    want = sorted((-token_set("alpha news today", t), n, t) for n, t in enumerate(titles))[:3]
    assert [(r["title"], r["score"]) for r in got] == [(t, -s) for s, _, t in want]
    assert {r["title"]: r["id"] for r in got}["alpha news"] == 3


def test_cluster_count():
    cfg = ScreeningConfig()
    assert [clusters.cluster_count(n, cfg) for n in (4, 50, 6000, 10**7)] == [4, 10, 54, 200]


def test_fit_clusters(spark):
    library, _ = frames(spark, make(21))
    cfg = ScreeningConfig(kmeans_restarts=2, kmeans_iterations=10, min_clusters=4)
    assigned, centroids = clusters.fit_clusters(library.vectors, cfg, k=4)
    total = library.vectors.count()
    assert assigned.count() == assigned.select("id").distinct().count() == total
    sizes = {r["cluster_id"]: r["size"] for r in centroids.collect()}
    assert sum(sizes.values()) == total and len(sizes) == 4
    again, _ = clusters.fit_clusters(library.vectors, cfg, k=4)
    assert sorted(r["size"] for r in clusters.cluster_sizes(again).collect()) == sorted(v for v in sizes.values() if v)


def test_oversized_model_is_refused(spark):
    model = spark.range(20).select(F.col("id").cast("int").alias("cluster_id"), F.array(F.lit(1.0)).alias("centroid"))
    with pytest.raises(ValueError):
        clusters.load_model(model, ScreeningConfig(max_model_rows=10))


def test_pruning_keeps_neighbours_of_queries_near_a_centroid(spark):
    """Angles near 0 lose nothing: copies of the centroid and vectors just beside it, in few and many dimensions."""
    import numpy as np

    for seed, dimension, k in ((1, 4, 5), (2, 384, 1)):
        gen = np.random.default_rng(seed)
        centres = unit_rows(gen.normal(size=(3, dimension)))
        beside = unit_rows(np.repeat(centres, 60, axis=0) + 10.0 ** gen.uniform(-6, -0.5, size=(180, 1)) * gen.normal(size=(180, dimension)))
        points = np.concatenate([beside, centres, centres])
        asked = unit_rows(np.repeat(centres, 8, axis=0) + 10.0 ** gen.uniform(-7, -3, size=(24, 1)) * gen.normal(size=(24, dimension)))
        vectors = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(points)], "id long, embedding array<float>")
        queries = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate([*asked, *centres])],
                                        "proposal_id long, embedding array<float>")
        cfg = ScreeningConfig(corpus_block_rows=20, proposal_block_rows=8)
        plain = knn.nearest_neighbours(queries, vectors, k, cfg).collect()
        pruned = knn.nearest_neighbours(queries, vectors, k, cfg, centres, prune_from=0).collect()
        assert sorted(plain) == sorted(pruned)


def test_ceilings_hold():
    import numpy as np

    gen = np.random.default_rng(4)
    for dimension in (3, 64, 384):
        centre = unit_rows(gen.normal(size=(1, dimension)))
        spread = 10.0 ** gen.uniform(-7, 0, size=(2000, 1))
        points, asked = (unit_rows(centre + spread * gen.normal(size=(2000, dimension))) for _ in range(2))
        angle = knn._angles(points, centre)[:, 0]
        for q, p, a in zip(asked, points, angle):
            cell = knn.Cells(centre, 1, [{"cell": 0, "n": 1, "low": a, "high": a}])
            assert cell.ceilings(q[None])[0, 0] >= (q.astype(np.float64) * p.astype(np.float64)).sum()


def test_vectors_with_gaps_are_refused():
    import pyarrow as pa

    from titlesieve.functions.vectors import matrix

    assert matrix(pa.array([[1.0, 2.0], [3.0, 4.0]])).shape == (2, 2)
    for rows in ([[1.0, 0.0], None], [[1.0], [1.0, 2.0]], [[1.0, None]]):
        with pytest.raises(ValueError):
            matrix(pa.array(rows, pa.list_(pa.float32())))


def test_repeated_updates_do_not_multiply_rows(spark):
    from titlesieve.operators.updates import update_column

    table = spark.createDataFrame([(1, 5), (2, 6)], "id long, position long")
    fresh = spark.createDataFrame([(1, 7), (1, 9), (3, 1)], "id long, position long")
    assert sorted(map(tuple, update_column(table, fresh, "position").collect())) == [(1, 9), (2, 6)]


def test_fallback_scope_is_whole(spark):
    cfg = ScreeningConfig(top_k=2)
    corpus = spark.range(800).select("id", F.concat(F.lit("title "), "id").alias("title"), F.lit("active").alias("record_status"))
    asked = spark.createDataFrame([(1, "title 777", [])], "proposal_id long, title string, cluster_ids array<int>")
    assert fuzzy.fuzzy_hits(*fuzzy.scope(asked, corpus, cfg, False), cfg).filter("lex_rank = 1").first()["title"] == "title 777"


def test_percentiles_by_rank(spark):
    import numpy as np

    from titlesieve.plans.status import percentiles

    values = [float(x) for x in np.random.default_rng(3).integers(0, 40, size=501)]
    rows = spark.createDataFrame([(v,) for v in values] + [(None,)], "ms double")
    got = percentiles(rows, "ms", (0.0, 0.5, 0.95, 0.99, 1.0)).first()
    assert np.allclose(list(got), np.percentile(values, [0, 50, 95, 99, 100]))
    assert list(percentiles(rows.limit(0), "ms", (0.5,)).first()) == [None]


def test_restarts_share_their_passes_and_end_as_each_would_alone(spark, monkeypatch):
    from pyspark.ml.functions import array_to_vector

    gen = np.random.default_rng(3)
    at = gen.normal(size=(6, 5))[gen.integers(0, 6, 400)] + gen.normal(scale=0.4, size=(400, 5))
    rows = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(at)], "id long, embedding array<double>")
    cfg, asked, plain = ScreeningConfig(kmeans_restarts=3, kmeans_iterations=40), [], clusters.KMeans
    points = rows.select("id", array_to_vector("embedding").alias("features"))
    alone = [plain(k=6, seed=cfg.kmeans_seed + r, maxIter=40, tol=1e-4).fit(points) for r in range(3)]
    best = min(alone, key=lambda m: m.summary.trainingCost)

    def starting(**options):
        asked.append(options["maxIter"])
        return plain(**options)

    monkeypatch.setattr(clusters, "KMeans", starting)
    assigned, centroids = clusters.fit_clusters(rows, cfg, k=6)
    assert asked == [0, 0, 0]  # Spark's fit only draws the starts
    got = np.array([r["centroid"] for r in centroids.orderBy("cluster_id").collect()])
    assert np.allclose(got, np.array(best.clusterCenters()), atol=1e-6)
    want = {r["id"]: r["prediction"] for r in best.transform(points).collect()}
    assert {r["id"]: r["cluster_id"] for r in assigned.collect()} == want
