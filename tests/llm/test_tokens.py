"""The last stage of the pipeline: encoding and decoding do not run in the same tasks."""

import corpus_pipeline
from pyspark.sql import functions as F


def test_a_task_of_tokens_has_one_python_worker(spark):
    docs = spark.createDataFrame([(1, "en", "web", "two words"), (2, None, None, ""), (3, "de", "web", None)],
                                 "doc_id long, lang string, source string, text string")
    told = corpus_pipeline.tokens(spark, docs, "")
    assert told._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    rows = {r["doc_id"]: r for r in told.collect()}
    assert rows[1]["n_tokens"] > 0 and rows[2]["n_tokens"] == rows[3]["n_tokens"] == 0
    assert told.filter(F.col("decodes")).count() == 3
