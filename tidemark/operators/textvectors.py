"""Text to unit vectors: hashed term weights, computed once per distinct text."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import IDF, HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import tokens

DIM = 384


def fit_text_model(texts: DataFrame, dim: int = DIM, column: str = "text") -> PipelineModel:
    """Term weights of a corpus; what is fitted is one number per dimension."""
    words = texts.select(tokens(F.col(column)).alias("words"))
    stages = [
        HashingTF(inputCol="words", outputCol="tf", numFeatures=dim),
        IDF(inputCol="tf", outputCol="weighted"),
        Normalizer(inputCol="weighted", outputCol="unit"),
    ]
    return Pipeline(stages=stages).fit(words)


def text_vectors(
    texts: DataFrame, model: PipelineModel, store: DataFrame | None = None, column: str = "text"
) -> DataFrame:
    """(key, vec) of texts that are not in `store` (key, vec) yet; key = hash of the text."""
    keyed = texts.select(F.sha2(column, 256).alias("key"), F.col(column).alias("_text"))
    due = keyed.dropDuplicates(["key"])
    if store is not None:
        due = due.join(store.select("key"), "key", "left_anti")
    out = model.transform(due.withColumn("words", tokens(F.col("_text"))))
    return out.select("key", vector_to_array("unit", "float32").alias("vec"))
