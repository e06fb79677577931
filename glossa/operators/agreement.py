"""Agreement between raters, and paired tests on binary markers."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Gates of the rating protocols.
KAPPA_GATE, ICC_GATE = 0.80, 0.70


def ratings_wide(ratings: DataFrame, item: str, rater: str, score: str, raters: Sequence[str]) -> DataFrame:
    """One row per item with one column per named rater."""
    return ratings.groupBy(item).pivot(rater, list(raters)).agg(F.first(score, ignorenulls=True))


def cohen_kappa(df: DataFrame, rater_a: str, rater_b: str) -> DataFrame:
    """Cohen's κ over rows rated by both; the confusion table is counted first."""
    cells = (
        df.filter(F.col(rater_a).isNotNull() & F.col(rater_b).isNotNull())
        .groupBy(F.col(rater_a).alias("a"), F.col(rater_b).alias("b"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    zero = F.lit(0).cast("bigint")

    def margin(category: Column, na: Column, nb: Column) -> Column:
        return F.struct(category.alias("category"), na.alias("na"), nb.alias("nb"))

    margins = (
        cells.select(F.inline(F.array(margin(F.col("a"), F.col("n"), zero), margin(F.col("b"), zero, F.col("n")))))
        .groupBy("category")
        .agg(F.sum("na").alias("na"), F.sum("nb").alias("nb"))
    )
    chance = margins.agg(F.sum(F.col("na").cast("double") * F.col("nb"))).scalar()
    counted = cells.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("agree"))
    return _kappa(counted.withColumn("observed", F.col("agree") / F.col("n")).withColumn(
        "expected", chance / (F.col("n").cast("double") * F.col("n"))
    )).select("n", "observed", "expected", "kappa")


def _kappa(df: DataFrame) -> DataFrame:
    value = (F.col("observed") - F.col("expected")) / (1 - F.col("expected"))
    return df.withColumn("kappa", F.when(F.col("expected") < 1, value))


def pairwise_kappa(wide: DataFrame, raters: Sequence[str]) -> DataFrame:
    """Cohen's κ for every pair of the named raters; raters are columns, so no rows are paired."""
    tables = [
        cohen_kappa(wide, a, b).select(F.lit(a).alias("rater_a"), F.lit(b).alias("rater_b"), "*")
        for a, b in combinations(raters, 2)
    ]
    return reduce(DataFrame.unionByName, tables)


def fleiss_kappa(ratings: DataFrame, item: str, category: str) -> DataFrame:
    """Fleiss' κ; items with fewer than two ratings carry no agreement and are left out, as are ratings of no item."""
    cells = ratings.filter(F.col(category).isNotNull() & F.col(item).isNotNull()).groupBy(item, category).agg(F.count(F.lit(1)).alias("n"))
    items = cells.groupBy(item).agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.col("n")).alias("ss")).filter("m >= 2")
    observed = items.agg(
        F.avg((F.col("ss") - F.col("m")) / (F.col("m") * (F.col("m") - 1))).alias("observed"),
        F.count(F.lit(1)).alias("n_items"),
        F.sum("m").alias("n_ratings"),
    )
    shares = cells.join(items.select(item), item).groupBy(category).agg(F.sum("n").alias("n"))
    chance = shares.agg(F.sum(F.col("n").cast("double") * F.col("n")) / F.pow(F.sum("n").cast("double"), 2)).scalar()
    return _kappa(observed.withColumn("expected", chance)).select("n_items", "n_ratings", "observed", "expected", "kappa")


def icc21(wide: DataFrame, raters: Sequence[str]) -> DataFrame:
    """ICC(2,1): two-way random effects, single rater, absolute agreement.

    Raters are columns, so all sums of squares come from one aggregation. Rows with
    a missing rating are left out.
    """
    k = len(raters)
    complete = wide.na.drop(subset=list(raters)).select(
        *[F.col(r).cast("double").alias(f"_r{i}") for i, r in enumerate(raters)]
    )
    names = [f"_r{i}" for i in range(k)]
    item_mean = reduce(Column.__add__, [F.col(c) for c in names]) / k
    stats = complete.agg(
        F.count(F.lit(1)).alias("n"),
        F.var_pop(item_mean).alias("_vi"),
        *[F.avg(c).alias(f"_m{c}") for c in names],
        *[F.var_pop(c).alias(f"_v{c}") for c in names],
    )
    n = F.col("n")
    grand = reduce(Column.__add__, [F.col(f"_m{c}") for c in names]) / k
    between_raters = reduce(Column.__add__, [F.pow(F.col(f"_m{c}") - grand, 2) for c in names])
    within = reduce(Column.__add__, [F.col(f"_v{c}") for c in names])
    ms_items = k * n * F.col("_vi") / (n - 1)
    ms_raters = n * between_raters / (k - 1)
    residual = n * (within + between_raters) - k * n * F.col("_vi") - n * between_raters
    ms_error = residual / ((n - 1) * (k - 1))
    icc = (ms_items - ms_error) / (ms_items + (k - 1) * ms_error + k * (ms_raters - ms_error) / n)
    return stats.select(
        "n", ms_items.alias("ms_items"), ms_raters.alias("ms_raters"), ms_error.alias("ms_error"), icc.alias("icc")
    )


def mcnemar(df: DataFrame, first: str, second: str) -> DataFrame:
    """McNemar's test on two binary columns of the same rows; χ² is null without discordant rows."""
    a, b = F.col(first).cast("boolean"), F.col(second).cast("boolean")
    counted = df.agg(
        F.count_if(a & b).alias("both"),
        F.count_if(a & ~b).alias("only_first"),
        F.count_if(~a & b).alias("only_second"),
        F.count_if(~a & ~b).alias("neither"),
    )
    difference, discordant = F.col("only_first") - F.col("only_second"), F.col("only_first") + F.col("only_second")
    return counted.withColumn("chi2", F.when(discordant > 0, difference * difference / discordant))
