"""Linear projection and topic assignment with Spark's own estimators.

Both fit when called, as any Spark estimator does; the fitted models score rows in place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .summaries import drop_small_topics


def pca(df: DataFrame, vector: str, k: int = 2, out: str = "projected") -> DataFrame:
    """First ``k`` principal components; each component's largest loading is made positive, so signs are settled."""
    data = df.withColumn("_features", array_to_vector(vector))
    model = PCA(k=k, inputCol="_features", outputCol="_scores").fit(data.select("_features"))
    loadings = model.pc.toArray()
    signs = [1.0 if loadings[abs(loadings[:, i]).argmax(), i] >= 0 else -1.0 for i in range(k)]
    scores = vector_to_array("_scores")
    flipped = F.zip_with(scores, F.lit(signs), lambda v, s: v * s)
    return model.transform(data).withColumn(out, flipped).drop("_features", "_scores")


def assign_topics(df: DataFrame, vector: str, k: int, seed: int = 42, out: str = "topic") -> DataFrame:
    """Topic of every row from one k-means over all vectors, so topics mean the same in every slice."""
    data = df.withColumn("_features", array_to_vector(vector))
    model = KMeans(k=k, seed=seed, featuresCol="_features", predictionCol=out).fit(data.select("_features"))
    return model.transform(data).drop("_features")


def slice_topics(df: DataFrame, keys: Sequence[str], vector: str, k: int, minimum: int, seed: int = 42) -> DataFrame:
    """Topics with those too small within their slice turned into the outlier topic."""
    return drop_small_topics(assign_topics(df, vector, k, seed), keys, "topic", minimum)
