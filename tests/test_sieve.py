"""A stored table thinned by the keys of a batch: what the plan holds of the keys."""

from pyspark.sql import functions as F

from titlesieve.config import ScreeningConfig
from titlesieve.operators import bloom, exact


def titles(spark, n, step=1):
    return spark.range(0, n, step).select(F.col("id").alias("proposal_id"), F.concat(F.lit("form "), "id").alias("normalized_title"))


def test_the_plan_does_not_grow_with_the_keys(spark):
    stored = titles(spark, 30_000).select("normalized_title", F.lit(2).cast("long").alias("exact_total"), F.array("proposal_id").alias("exact_ids"))
    heads = stored.withColumn("bucket", exact.head_bucket(F.col("normalized_title"), 4))
    found = exact.stored_heads(titles(spark, 30_000, 3), heads, 5, ScreeningConfig(head_buckets=4))
    assert len(found._jdf.queryExecution().toString()) < 100_000  # the bits are 65,536 hexadecimal digits, four times
    assert sorted((r["proposal_id"], r["exact_total"], r["exact_ids"]) for r in found.collect()) == [(i, 2, [i]) for i in range(0, 30_000, 3)]


def test_pieces_say_what_the_whole_filter_says(spark):
    keys = titles(spark, 3_000, 3)
    sieve = bloom.build(keys, "normalized_title", 1_000, 2, 1 << 20)  # few bits, so that other rows pass too
    rows = titles(spark, 9_000).unionByName(spark.createDataFrame([(-1, None)], "proposal_id long, normalized_title string"))
    told = rows.filter(sieve.may_hold(F.col("normalized_title")))
    thinned = sieve.thinned(rows, "normalized_title")
    assert thinned.columns == rows.columns
    assert sorted(thinned.collect()) == sorted(told.collect()) and thinned.count() >= 1_000
    assert bloom.build(keys.limit(0), "normalized_title", 0, 16, 1 << 20).thinned(rows, "normalized_title").isEmpty()
