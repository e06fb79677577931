"""Silhouettes from cluster moments, so that no two rows are ever paired.

The mean squared Euclidean distance of a point to a cluster is
``|x|² − 2 x·μ + mean|y|²``, and the mean cosine distance is one minus the dot
product with the cluster's mean unit vector. One pass makes the moments, a second
scores the points against them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import null_safe_join
from ..functions.text import words
from ..functions.vectors import dot, l2_normalize, squared_norm
from ..session import kept
from .conformity import centroids

# Seeds of the stability protocol and the deviation that flags a score.
SEEDS, UNSTABLE_ABOVE = 5, 0.05
# Fixed value: smallest subset that gets a score of its own.
MIN_SUBSET = 10
# Cells (doubles) of cluster means that travel together, on average, and the parts that a group's rows are dealt into.
BLOCK_CELLS, PARTS = 1 << 15, 16
# Copies of a row that are written out at once.
COPIES = 4096


def _prepared(df: DataFrame, groups: Sequence[str], label: str, vector: str, cosine: bool, keep: Sequence[str]) -> DataFrame:
    unit = l2_normalize(vector) if cosine else F.col(vector)
    rows = df.select(*keep, *groups, F.col(label).alias("_label"), unit.alias("_v"))
    return rows.filter(F.col("_v").isNotNull() & F.col("_label").isNotNull()).withColumn("_sq", squared_norm("_v"))


def _moments(rows: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Size, mean vector and mean squared length per cluster, in one aggregation.

    The squared length rides along as an extra first element of the vector.
    """
    longer = rows.select(*groups, "_label", F.concat(F.array("_sq"), F.col("_v").cast("array<double>")).alias("_long"))
    both = centroids(longer, [*groups, "_label"], "_long", "_mean")
    return both.select(
        *groups, "_label", "n", F.slice("_mean", F.lit(2), F.size("_mean") - 1).alias("mu"), F.col("_mean")[0].alias("msq")
    )


def _score(own: Column, other: Column, size: Column) -> Column:
    a = own * size / (size - 1)
    return F.when(size == 1, F.lit(0.0)).when(F.greatest(a, other) > 0, (other - a) / F.greatest(a, other)).otherwise(0.0)


def _blocks(clusters: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Cut the clusters of each group into lists of bounded size, once for every part of the group's rows."""
    cells = clusters.groupBy(*groups).agg(F.sum(F.size("mu")).alias("_cells"))
    block = F.pmod(F.xxhash64("_label"), F.ceil(F.col("_cells") / BLOCK_CELLS)).alias("_block")
    dealt = null_safe_join(clusters, cells, groups).select(*clusters.columns, block)
    lists = dealt.groupBy(*groups, "_block").agg(F.collect_list(F.struct("_label", "n", "mu", "msq")).alias("_clusters"))
    return lists.select(*groups, "_clusters", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("_part"))


def _scored(
    df: DataFrame, groups: Sequence[str], label: str, vector: str, cosine: bool, keep: Sequence[str]
) -> DataFrame:
    """``keep``, groups, ``_label``, ``silhouette`` and ``_copies``, one row per distinct row.

    A row meets the blocks of its group one by one and keeps its own cluster's distance and the least other. Only those
    numbers are combined per row, under the row's columns and two hashes of its vector, so rows need no key. Exactly one
    block holds a row's own cluster, so counting it counts copies.
    """
    groups = list(groups) or ["_all"]
    base = df if groups != ["_all"] else df.withColumn("_all", F.lit(0))
    rows = _prepared(base, groups, label, vector, cosine, [k for k in keep if k not in groups])
    blocks = _blocks(_moments(rows, groups), groups)
    marks = [F.xxhash64(F.lit(i), "_v").alias(f"_mark{i}") for i in range(2)]
    # Any part is right for a row; the task number spreads equal vectors too.
    part = F.pmod(F.xxhash64("_mark0", F.spark_partition_id()), F.lit(PARTS)).cast("int")
    parted = rows.select("*", *marks).withColumn("_part", part)
    distances = F.transform(
        "_clusters",
        lambda c: F.struct(
            c["_label"].alias("label"),
            c["n"].alias("n"),
            F.greatest(F.col("_sq") - 2 * dot("_v", c["mu"]) + c["msq"], F.lit(0.0)).alias("d"),
        ),
    )
    met = null_safe_join(parted, blocks, [*groups, "_part"]).withColumn("_d", distances)
    own = F.filter("_d", lambda c: c["label"] == F.col("_label"))
    other = F.array_min(F.transform(F.filter("_d", lambda c: c["label"] != F.col("_label")), lambda c: c["d"]))
    names = list(dict.fromkeys([*keep, *groups, "_label"]))
    near = met.select(*names, "_mark0", "_mark1", F.get(own, 0).alias("_own"), other.alias("_other"))
    best = near.groupBy(*names, "_mark0", "_mark1").agg(
        F.min("_other").alias("_other"),
        F.max("_own.d").alias("_own"),
        F.max("_own.n").alias("_n"),
        F.count("_own").alias("_copies"),
    )
    value = F.when(F.col("_other").isNotNull(), _score(F.col("_own"), F.col("_other"), F.col("_n")))
    return best.select(*[c for c in names if c != "_all"], value.alias("silhouette"), "_copies")


def silhouette_samples(
    df: DataFrame, groups: Sequence[str], label: str, vector: str, cosine: bool = False, keep: Sequence[str] = ()
) -> DataFrame:
    """Silhouette of every point within its group; null where the group has a single label.

    Any number of clusters and copies. A null group is a group of its own; a row without label or vector takes no part.
    """
    scored = _scored(df, groups, label, vector, cosine, keep)
    names = [c for c in scored.columns if c not in ("_label", "silhouette", "_copies")]
    full = F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_copies") - 1) / COPIES))
    runs = scored.select(*names, "_label", "silhouette", "_copies", F.explode(full).alias("_run"))
    left = F.least(F.col("_copies") - F.col("_run") * COPIES, F.lit(COPIES)).cast("int")
    each = runs.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), left)))
    return each.select(*names, F.col("_label").alias(label), "silhouette")


def silhouette(
    df: DataFrame, groups: Sequence[str], label: str, vector: str, cosine: bool = False, minimum: int = MIN_SUBSET
) -> DataFrame:
    """Mean silhouette per group; null below ``minimum`` points or with a single label."""
    scored = _scored(df, groups, label, vector, cosine, ())
    n = F.sum("_copies")
    mean = F.sum(F.col("silhouette") * F.col("_copies")) / F.sum(F.when(F.col("silhouette").isNotNull(), F.col("_copies")))
    return scored.groupBy(*groups).agg(F.when(n >= minimum, mean).alias("silhouette"), F.coalesce(n, F.lit(0)).alias("n"))


def sign_vector(seed: int, component: int, dim: int) -> list[float]:
    """±1 by the parity of a hash of (seed, component, position)."""
    return [
        1.0 - 2.0 * (hashlib.md5(f"{seed}:{component}:{i}".encode()).digest()[0] % 2) for i in range(1, dim + 1)
    ]


def project(df: DataFrame, vector: str, dim: int, seeds: int = SEEDS, components: int = 2) -> DataFrame:
    """Replace each row by its seeded random projections, one row per seed.

    The sign matrices are short literals; a projection is linear, so it stands in
    for the non-linear reduction as a scalable check of seed dependence.
    """
    plane = [
        F.struct(
            F.lit(seed).alias("seed"),
            F.array(*[dot(vector, F.lit(sign_vector(seed, c, dim))) for c in range(components)]).alias("projected"),
        )
        for seed in range(seeds)
    ]
    rest = [c for c in df.columns if c != vector]
    return df.select(*rest, F.inline(F.array(*plane)))


def silhouette_stability(
    df: DataFrame, groups: Sequence[str], label: str, vector: str, dim: int, seeds: int = SEEDS, minimum: int = MIN_SUBSET
) -> DataFrame:
    """Mean and population deviation of the silhouette over seeded projections, with a flag."""
    projected = project(df.select(*groups, label, vector), vector, dim, seeds)
    per_seed = silhouette(projected, [*groups, "seed"], label, "projected", minimum=minimum)
    return per_seed.groupBy(*groups).agg(
        F.avg("silhouette").alias("mean"),
        F.stddev_pop("silhouette").alias("std"),
        (F.stddev_pop("silhouette") > UNSTABLE_ABOVE).alias("unstable"),
        F.max("n").alias("n"),
    )


def context_against_lemma(
    df: DataFrame, groups: Sequence[str], lemma: str, context: str, vector: str, paraphrase: Column, cosine: bool = False
) -> DataFrame:
    """Silhouettes by lemma and by context per group, by context within paraphrases, and the difference.

    The three labellings are one more group key, so all scores come from one plan.
    A paraphrase subset too small or with one context keeps its row, with a null.
    """

    def labelling(name: str, label: str) -> Column:
        return F.struct(F.lit(name).alias("_labelling"), F.col(label).cast("string").alias("_value"))

    entries = F.array(
        labelling("lemma", lemma), labelling("context", context), F.when(paraphrase, labelling("paraphrase", context))
    )
    long = df.select(*groups, vector, F.inline(F.filter(entries, lambda e: e.isNotNull())))
    scores = silhouette(long, [*groups, "_labelling"], "_value", vector, cosine)

    def of(name: str, value: str) -> Column:
        return F.max(F.when(F.col("_labelling") == name, F.col(value)))

    wide = scores.groupBy(*groups).agg(
        of("lemma", "silhouette").alias("sil_lemma"),
        of("lemma", "n").alias("n"),
        of("context", "silhouette").alias("sil_ctx"),
        of("paraphrase", "silhouette").alias("sil_ctx_paraphrase"),
    )
    return wide.filter(F.col("n") >= MIN_SUBSET).withColumn("delta_ctx_lemma", F.col("sil_ctx") - F.col("sil_lemma"))


def delta_by_stratum(results: DataFrame, stratum: str) -> DataFrame:
    """Mean difference per stratum over the combinations of model and embedder."""
    return results.groupBy(stratum).agg(F.avg("delta_ctx_lemma").alias("mean_delta"), F.count(F.lit(1)).alias("n_combinations"))


def union_embedders(results: dict[str, DataFrame]) -> DataFrame:
    """Results of several embedders under one table with their name."""
    return reduce(DataFrame.unionByName, [df.withColumn("embed_key", F.lit(name)) for name, df in results.items()])


# --- TF-IDF baseline --------------------------------------------------------


def tfidf(corpus: DataFrame, doc_id: str, text: str, *keep: str) -> DataFrame:
    """Unit-length TF-IDF weights, one row per document and word: ``tf · ln((N+1)/(df+1))``.

    ``keep`` names further columns of a document to carry along. Texts are dealt out by document before they are taken
    apart, so the words of a document are counted and weighed where it lies. Document frequencies are written to the shared
    folder when this is called: Spark knows their size and sends them to the words if they are small enough.
    """
    from pyspark.sql import Window

    keys = [doc_id, *keep]
    tasks = int(corpus.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = corpus.select(*keys, text).repartition(tasks, doc_id)
    tf = dealt.select(*keys, F.explode(words(text)).alias("token")).groupBy(*keys, "token").agg(F.count(F.lit(1)).alias("tf"))
    total = corpus.agg(F.count(F.lit(1))).scalar()
    df = kept(tf.groupBy("token").agg(F.count(F.lit(1)).alias("df")), "frequencies").withColumn(
        "idf", F.ln((total + 1) / (F.col("df") + 1))
    )
    weighted = tf.join(df, "token").select(*keys, "token", (F.col("tf") * F.col("idf")).alias("w"))
    # A document's words are its own; no window grows beyond one text's vocabulary.
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(doc_id)))
    return weighted.withColumn("_length", length).filter(F.col("_length") > 0).select(
        *keys, "token", (F.col("w") / F.col("_length")).alias("w")
    )


def document_frequency(corpus: DataFrame, text: str) -> DataFrame:
    return corpus.select(F.explode(F.array_distinct(words(text))).alias("token")).groupBy("token").agg(
        F.count(F.lit(1)).alias("df")
    )


def tfidf_silhouette(corpus: DataFrame, doc_id: str, text: str, label: str) -> DataFrame:
    """Mean cosine silhouette of documents under a labelling, on TF-IDF weights.

    A document meets a cluster through the words they share, joined on the word
    with the cluster's mean weights, so vectors stay sparse throughout. A document
    without label takes no part in clusters or in the mean.
    """
    labels = corpus.filter(F.col(label).isNotNull()).select(doc_id, F.col(label).alias("_label"))
    sizes = labels.groupBy("_label").agg(F.count(F.lit(1)).alias("_n"))
    # Weights and means are written down once: weights lie by document then, and the means go to them if they are small enough.
    tagged = kept(tfidf(corpus.withColumn("_label", F.col(label)), doc_id, text, "_label"), "weights")
    means = tagged.groupBy("_label", "token").agg(F.sum("w").alias("_sum")).join(sizes, "_label").select(
        F.col("_label").alias("_cluster"), "token", (F.col("_sum") / F.col("_n")).alias("mu")
    )
    means = kept(means, "means")
    dots = tagged.join(means, "token").groupBy(doc_id, "_label", "_cluster").agg(F.sum(F.col("w") * F.col("mu")).alias("dot"))
    same = F.col("_cluster") == F.col("_label")
    nearest = dots.groupBy(doc_id).agg(
        F.max(F.when(same, F.col("dot"))).alias("own"), F.coalesce(F.max(F.when(~same, F.col("dot"))), F.lit(0.0)).alias("other")
    )
    scored = labels.join(sizes, "_label").join(nearest, doc_id, "left")
    # A text without weighted words is at distance one from everything.
    value = F.when(F.col("own").isNull(), F.lit(0.0)).otherwise(
        _score(F.greatest(1 - F.col("own"), F.lit(0.0)), 1 - F.col("other"), F.col("_n"))
    )
    return scored.agg(
        F.when(F.count_distinct("_label") > 1, F.avg(value)).alias("silhouette"),
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("_label").alias("n_labels"),
    )
