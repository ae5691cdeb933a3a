"""Text encoders that turn titles into vectors of a fixed dimension."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import predict_batch_udf, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .text import is_blank
from .vectors import unit


def _or_zeros(text: str, vector, dimension: int):
    """Blank text has the zero vector."""
    zeros = F.array_repeat(F.lit(0.0).cast("float"), dimension)
    return F.when(is_blank(F.col(text)), zeros).otherwise(F.coalesce(vector, zeros))


class HashingEncoder:
    """Built-in default: hashed terms weighted by inverse document frequency, unit length."""

    name = "hashing-tf-idf"

    def __init__(self, dimension: int = 384, model: PipelineModel | None = None):
        self.dimension, self._model = dimension, model

    def fit(self, df: DataFrame, text: str) -> HashingEncoder:
        stages = [
            RegexTokenizer(inputCol="_text", outputCol="_terms", pattern=r"[^\p{L}\p{N}]+"),
            HashingTF(inputCol="_terms", outputCol="_tf", numFeatures=self.dimension),
            IDF(inputCol="_tf", outputCol="_idf"),
            Normalizer(inputCol="_idf", outputCol="_unit", p=2.0),
        ]
        model = Pipeline(stages=stages).fit(df.select(F.coalesce(text, F.lit("")).alias("_text")))
        return HashingEncoder(self.dimension, model)

    def encode(self, df: DataFrame, text: str, out: str = "embedding") -> DataFrame:
        if self._model is None:
            raise ValueError("fit the encoder before encoding")
        done = self._model.transform(df.withColumn("_text", F.coalesce(text, F.lit(""))))
        vector = vector_to_array("_unit", "float32")
        return done.withColumn(out, _or_zeros(text, vector, self.dimension)).drop(
            "_text", "_terms", "_tf", "_idf", "_unit"
        )

    def save(self, path: str) -> None:
        self._model.write().overwrite().save(path)

    @classmethod
    def load(cls, path: str, dimension: int = 384) -> HashingEncoder:
        return cls(dimension, PipelineModel.load(path))


class ModelEncoder:
    """Plug-in: ``make_predict`` loads any model once per Python worker and returns a function from
    a batch of strings to an (n, dimension) array."""

    def __init__(self, make_predict: Callable, dimension: int = 384, batch_size: int = 64, name: str = "custom"):
        self.dimension, self.name = dimension, name
        self._udf = predict_batch_udf(make_predict, return_type=ArrayType(FloatType()), batch_size=batch_size)

    def fit(self, df: DataFrame, text: str) -> ModelEncoder:
        return self

    def encode(self, df: DataFrame, text: str, out: str = "embedding") -> DataFrame:
        raw = df.withColumn("_raw", self._udf(F.coalesce(text, F.lit(""))))
        return raw.withColumn(out, _or_zeros(text, unit(F.col("_raw")), self.dimension)).drop("_raw")
