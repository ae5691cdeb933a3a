import pytest
from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("kept", T.StringType()),
    T.StructField("size", T.StringType()), T.StructField("ids", T.StringType()), T.StructField("rank", T.StringType()),
])


@pytest.fixture(scope="session")
def docs(spark):
    """Makes documents from (doc_id, text, lang, source) with further columns whose names clash."""

    def make(rows):
        full = [(*r, len(r[1]) if r[1] is not None else None, "k", "s", "i", "r") for r in rows]
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture(scope="session")
def awkward(docs):
    """Nulls in every column, empty and wordless texts, repeated rows, ties and one very long text."""
    long = " ".join(f"word{i % 977}" for i in range(60_000))
    return docs([
        (1, None, None, None), (2, "", "en", "a"), (3, " \n\t ", "en", "a"), (4, "alpha beta gamma delta epsilon zeta", "en", "a"),
        (4, "alpha beta gamma delta epsilon zeta", "en", "a"), (5, "alpha beta gamma delta epsilon zeta", None, "b"),
        (None, "a text without an id that has some words in it", "en", None), (7, "12 34 !!", "de", "b"), (8, long, "en", "a"),
        (None, None, None, None), (9, "x", "fr", "c"),
    ])
