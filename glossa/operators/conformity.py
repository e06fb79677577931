"""Schema conformity: similarity of each response to the prototype of its concept."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import cosine, norm


def centroids(vectors: DataFrame, keys: Sequence[str], vector: str, out: str = "centroid") -> DataFrame:
    """Mean vector and row count per key.

    The explode feeds a map-side partial average, so at most keys × dimensions
    partial rows leave each task; a key holding most rows costs no more than others.
    """
    long = vectors.select(*keys, F.posexplode(vector).alias("pos", "v"))
    means = long.groupBy(*keys, "pos").agg(F.avg(F.col("v").cast("double")).alias("v"), F.count(F.lit(1)).alias("n"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda e: e["v"])
    return means.groupBy(*keys).agg(ordered.alias(out), F.max("n").alias("n"))


def top_features(mentions: DataFrame, keys: Sequence[str], feature: str, k: int) -> DataFrame:
    """The ``k`` features named most often per concept, ties by name.

    ``rank <= k`` over a counted table: Spark limits each group before the shuffle.
    """
    from pyspark.sql import Window

    counts = mentions.groupBy(*keys, feature).agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(*keys).orderBy(F.desc("n"), F.asc(feature))
    return counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def feature_prototypes(
    mentions: DataFrame, features: DataFrame, keys: Sequence[str], feature: str, vector: str, k: int
) -> DataFrame:
    """Prototype = centroid of the vectors of a concept's ``k`` most elicited features."""
    chosen = top_features(mentions, keys, feature, k).join(features, feature)
    return centroids(chosen, keys, vector, "prototype")


def attach_embeddings(responses: DataFrame, embeddings: DataFrame, key: str) -> DataFrame:
    return responses.join(embeddings, key)


def embedding_mismatch(responses: DataFrame, embeddings: DataFrame, key: str) -> DataFrame:
    """Rows on either side without a partner; two zeros mean the tables match."""
    left = responses.select(key, F.lit(1).alias("r"))
    right = embeddings.select(key, F.lit(1).alias("e"))
    return left.join(right, key, "full_outer").agg(
        F.count_if(F.col("r").isNull()).alias("embeddings_without_response"),
        F.count_if(F.col("e").isNull()).alias("responses_without_embedding"),
        F.count_if(F.col("r").isNotNull() & F.col("e").isNotNull()).alias("matched"),
    )


def conformity(
    responses: DataFrame,
    prototypes: DataFrame,
    on: str,
    vector: str = "embedding",
    prototype: str = "prototype",
) -> DataFrame:
    """Cosine similarity of every response to its concept's prototype, all other columns kept.

    Responses of a concept without prototype drop out; see ``coverage_gap``. The
    prototype table carries no broadcast hint: Spark broadcasts it while it is
    small and otherwise shuffles, splitting skewed concepts.
    """
    side = prototypes.select(on, F.col(prototype).alias("_proto"), norm(prototype).alias("_norm"))
    scored = responses.join(side, on)
    return scored.withColumn("conformity", cosine(vector, "_proto", norm_b="_norm")).drop("_proto", "_norm")


def group_mean(df: DataFrame, keys: Sequence[str], value: str, out: str | None = None) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(value).alias(out or value), F.count(value).alias("n"))


def concept_ranking(df: DataFrame, keys: Sequence[str], value: str, descending: bool = True) -> DataFrame:
    """Concept means in rank order, ties by key."""
    means = group_mean(df, keys, value)
    first = F.desc(value) if descending else F.asc(value)
    return means.orderBy(first, *keys)


def amplification(model_scores: DataFrame, corpus_scores: DataFrame, concept: str, value: str = "conformity") -> DataFrame:
    """Mean score of model output against that of corpus text, per concept."""
    llm = model_scores.groupBy(concept).agg(F.avg(value).alias("model_mean"), F.count(value).alias("n_model"))
    corpus = corpus_scores.groupBy(concept).agg(F.avg(value).alias("corpus_mean"), F.count(value).alias("n_corpus"))
    return llm.join(corpus, concept).withColumns(
        {
            "difference": F.col("model_mean") - F.col("corpus_mean"),
            "amplified": F.col("model_mean") > F.col("corpus_mean"),
        }
    )


def trajectory(df: DataFrame, unit: str, period: str, by: Sequence[str], value: str) -> DataFrame:
    """Mean of unit means per period, so that each unit counts once however many rows it has."""
    units = df.groupBy(unit, period, *by).agg(F.avg(value).alias("unit_mean"))
    return units.groupBy(period, *by).agg(F.avg("unit_mean").alias("mean"), F.count(F.lit(1)).alias("n_units"))
