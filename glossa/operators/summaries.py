"""Grouped summaries: accuracy, quality, entropy, effort, replication, adjudication."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.keys import null_safe_join
from ..functions.text import ENCYCLOPEDIC, reading_label

# Smallest topic of each topic-model preset, the outlier topic, and
# the group size below which a slice is left out.
TOPIC_PRESETS = {"conservative": 15, "default": 10, "fine_grained": 5}
OUTLIER = -1
MIN_GROUP = 10
# Fixed value: keeps a division by a zero range or zero quality finite.
EPSILON = 1e-9
TEST_SIDE = "sentence_b"
# Fixed value: name of the co-occurrence baseline system.
BASELINE = "gpt2_xl"


def count_rows(name: str = "n") -> Column:
    return F.count(F.lit(1)).alias(name)


# --- accuracy ---------------------------------------------------------------


def scored_responses(
    responses: DataFrame, response: str = "response", truth: str = "ground_truth", rule: Column | None = None
) -> DataFrame:
    """Add ``correct``: 1 if the response holds the ground truth, else 0; null without ground truth.

    Another ``rule`` of classification gives the label, or null where it cannot tell.
    """
    label = reading_label(response, truth) if rule is None else rule
    return responses.withColumn("correct", (label == ENCYCLOPEDIC).cast("int"))


def with_baseline(responses: DataFrame, baseline: DataFrame, name: str = BASELINE) -> DataFrame:
    """Union of the models' rows and the baseline's, both under ``system``.

    The baseline has no sampling temperature of its own, so it stands beside any
    slice of the models; filter on ``temperature`` to compare like with like.
    """
    models = responses.withColumnRenamed("model", "system")
    other = baseline.drop("model").withColumn("system", F.lit(name))
    return models.unionByName(other, allowMissingColumns=True)


def accuracy(df: DataFrame, keys: Sequence[str], correct: str = "correct", side: str | None = None) -> DataFrame:
    kept = df if side is None else df.filter(F.col(side) == TEST_SIDE)
    return kept.groupBy(*keys).agg(F.avg(correct).alias("accuracy"), F.count(correct).alias("n"))


def accuracy_panels(df: DataFrame, keys: Sequence[str], panel: str, correct: str = "correct") -> DataFrame:
    """Accuracy with one column per value of a boolean panel."""
    return df.groupBy(*keys).agg(
        F.avg(F.when(F.col(panel), F.col(correct))).alias("critical"),
        F.avg(F.when(~F.col(panel), F.col(correct))).alias("non_critical"),
    )


def versus_baseline(cells: DataFrame, keys: Sequence[str], baseline: str = BASELINE) -> DataFrame:
    """Each system's accuracy against the baseline's in the same cell."""
    reference = cells.filter(F.col("system") == baseline).select(*keys, F.col("accuracy").alias("baseline_accuracy"))
    others = cells.filter(F.col("system") != baseline)
    return others.join(reference, list(keys), "left").withColumn("gain", F.col("accuracy") - F.col("baseline_accuracy"))


# --- counts and means -------------------------------------------------------


def group_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(count_rows())


def large_groups(df: DataFrame, keys: Sequence[str], minimum: int = MIN_GROUP) -> DataFrame:
    return group_counts(df, keys).filter(F.col("n") >= minimum)


def distinct_counts(df: DataFrame, *columns: str) -> DataFrame:
    return df.agg(*[F.count_distinct(c).alias(f"n_{c}") for c in columns])


def range_stats(df: DataFrame, keys: Sequence[str], *values: str) -> DataFrame:
    """Minimum, maximum and mean of each value."""
    made = [f(v).alias(f"{v}_{name}") for v in values for name, f in (("min", F.min), ("max", F.max), ("mean", F.avg))]
    return df.groupBy(*keys).agg(*made)


def mean_and_sem(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean and standard error (sample deviation over √n); the error of one row is null."""
    n = F.count(value)
    sem = F.when(n > 1, F.stddev_samp(value) / F.sqrt(n))
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), sem.alias("sem"), n.alias("n"))


def cell_counts(df: DataFrame, factors: Mapping[str, Sequence[str]], minimum: int = MIN_GROUP) -> DataFrame:
    """Rows per cell of a full factor grid, empty cells included; cells under ``minimum`` are flagged.

    A value that is not among its factor's levels, null included, counts under a null level, so cells add up to the rows.
    """
    inside = [F.when(F.col(name).isin(list(levels)), F.col(name)).alias(name) for name, levels in factors.items()]
    counted = group_counts(df.select(*inside), list(factors))
    grid = df.sparkSession.range(1).select()
    for name, levels in factors.items():
        grid = grid.select("*", F.explode(F.array(*[F.lit(v) for v in levels])).alias(name))
    both = grid.withColumn("n", F.lit(0).cast("bigint")).unionByName(counted)
    cells = both.groupBy(*factors).agg(F.sum("n").alias("n"))
    return cells.withColumn("too_small", F.col("n") < minimum)


def level_gain(df: DataFrame, domain: str, complexity: str, level: str, value: str, low: int = 0, high: int = 3) -> DataFrame:
    """Quality gain from the lowest to the highest prompt level per domain, averaged by complexity."""
    gains = df.groupBy(complexity, domain).agg(
        (F.avg(F.when(F.col(level) == high, F.col(value))) - F.avg(F.when(F.col(level) == low, F.col(value)))).alias("gain")
    )
    return gains.groupBy(complexity).agg(F.avg("gain").alias("mean_gain"), F.count("gain").alias("n_domains"))


def log_totals(calls: DataFrame, keys: Sequence[str], usage: str = "usage") -> DataFrame:
    """Calls and token totals; a call without usage counts as a call."""
    fields = calls.schema[usage].dataType
    if not isinstance(fields, StructType):
        raise ValueError(f"column {usage} must be a struct")
    sums = [F.coalesce(F.sum(F.col(usage)[f.name]), F.lit(0)).alias(f.name) for f in fields.fields]
    return calls.groupBy(*keys).agg(count_rows("n_calls"), *sums)


def replication(df: DataFrame, finding: str, unit: str, holds: Column) -> DataFrame:
    """A finding stands only if it holds in every model (and embedder)."""
    return df.groupBy(finding).agg(
        F.bool_and(holds).alias("replicates"), F.count_if(holds).alias("n_holding"), F.count_distinct(unit).alias("n_units")
    )


# --- topics and entropy -----------------------------------------------------


def drop_small_topics(df: DataFrame, keys: Sequence[str], topic: str, minimum: int) -> DataFrame:
    """Give rows of topics smaller than ``minimum`` within their slice the outlier topic."""
    sizes = df.groupBy(*keys, topic).agg(count_rows("_size"))
    small = F.col("_size") < minimum
    sized = null_safe_join(df, sizes, [*keys, topic])
    return sized.withColumn(topic, F.when(small, F.lit(OUTLIER)).otherwise(F.col(topic))).drop("_size")


def topic_counts(df: DataFrame, keys: Sequence[str], topic: str, presets: Mapping[str, int] = TOPIC_PRESETS) -> DataFrame:
    """Rows per topic under each preset, small topics merged into the outlier topic.

    The presets multiply the counted table, not the rows.
    """
    counts = df.groupBy(*keys, topic).agg(count_rows("_n"))
    pairs = F.array(*[F.struct(F.lit(c).alias("config"), F.lit(m).alias("_min")) for c, m in presets.items()])
    long = counts.select(*keys, topic, "_n", F.inline(pairs))
    merged = F.when(F.col("_n") < F.col("_min"), F.lit(OUTLIER)).otherwise(F.col(topic))
    return long.groupBy(*keys, "config", merged.alias(topic)).agg(F.sum("_n").alias("n"))


def entropy_of_counts(counts: DataFrame, keys: Sequence[str], topic: str, n: str = "n", renormalize: bool = False) -> DataFrame:
    """Shannon entropy (bits) over topics without the outlier topic; 0 if only that is left.

    Shares are taken of all rows, outliers included, unless ``renormalize`` is set.
    """
    kept = F.col(topic) != OUTLIER
    rows = F.col(n).cast("double")
    kept_sum = F.coalesce(F.sum(F.when(kept, rows)), F.lit(0.0))
    base = kept_sum if renormalize else F.sum(rows)
    weighted = F.coalesce(F.sum(F.when(kept, rows * F.log2(rows))), F.lit(0.0))
    value = F.when(kept_sum > 0, (kept_sum * F.log2(base) - weighted) / base).otherwise(0.0)
    return counts.groupBy(*keys).agg(value.alias("entropy"))


def topic_entropy(df: DataFrame, keys: Sequence[str], topic: str, renormalize: bool = False) -> DataFrame:
    return entropy_of_counts(df.groupBy(*keys, topic).agg(count_rows()), keys, topic, renormalize=renormalize)


def preset_entropy(df: DataFrame, keys: Sequence[str], topic: str) -> DataFrame:
    return entropy_of_counts(topic_counts(df, keys, topic), [*keys, "config"], topic)


def config_pivot(entropies: DataFrame, keys: Sequence[str], value: str = "entropy", configs: Sequence[str] = tuple(TOPIC_PRESETS)) -> DataFrame:
    """One column per preset; rows lacking a preset are dropped, as an incomplete comparison."""
    return entropies.groupBy(*keys).pivot("config", list(configs)).agg(F.avg(value)).na.drop(subset=list(configs))


# --- effort -----------------------------------------------------------------


def effort_to_quality(df: DataFrame, parts: Sequence[str], quality: str) -> DataFrame:
    """Sum of the parts, each scaled to [0, 1] over the whole table, per unit of quality.

    The ranges come from one aggregation, used as a scalar subquery.
    """
    ends = df.agg(F.struct(*[f(p).cast("double").alias(f"{n}_{p}") for p in parts for n, f in (("lo", F.min), ("hi", F.max))])).scalar()
    ranged = df.withColumn("_ends", ends)
    for p in parts:
        low, high = F.col("_ends")[f"lo_{p}"], F.col("_ends")[f"hi_{p}"]
        ranged = ranged.withColumn(f"{p}_norm", (F.col(p) - low) / (high - low + F.lit(EPSILON)))
    effort = sum((F.col(f"{p}_norm") for p in parts[1:]), F.col(f"{parts[0]}_norm"))
    return ranged.drop("_ends").withColumn("effort", effort).withColumn(
        "effort_to_quality", F.col("effort") / (F.col(quality) + F.lit(EPSILON))
    )


# --- adjudication -----------------------------------------------------------


def adjudicate(outcomes: DataFrame, keys: Sequence[str], experiment: str = "experiment", confirmed: str = "confirmed") -> DataFrame:
    """Verdict on each thesis from the outcomes of its experiments, one row per key.

    Thesis 1: the mechanistic test (E4) takes precedence over the distributional (E1).
    Thesis 2: conformity (E2) and trajectory (E5) stand alone; both are needed for the full claim.
    Thesis 3: output side (E3) alone carries the quality claim, the user study (E3U) the inequality claim.
    A thesis whose verdict turns on an experiment without outcome is undetermined.
    """
    wide = outcomes.groupBy(*keys).pivot(experiment, ["E1", "E2", "E3", "E3U", "E4", "E5"]).agg(F.bool_and(confirmed))
    e1, e2, e3, e3u, e4, e5 = (F.col(c) for c in ("E1", "E2", "E3", "E3U", "E4", "E5"))
    open_ = F.lit("undetermined")
    return wide.select(
        *keys,
        F.when(e4 & e1, "confirmed").when(e4 & ~e1, "restricted").when(~e4 & e1, "disconfirmed").when(~e4 & ~e1, "fully disconfirmed").otherwise(open_).alias("thesis1"),
        F.when(e2 & e5, "confirmed").when(e2 & ~e5, "synchronic only").when(~e2 & e5, "diachronic only").when(~e2 & ~e5, "disconfirmed").otherwise(open_).alias("thesis2"),
        F.when(e3 & e3u, "inequality").when(e3 & ~e3u, "quality differential").when(~e3, "disconfirmed").otherwise(open_).alias("thesis3"),
    )


def overcoding_verdict(conformity_high: Column, entropy_high: Column) -> Column:
    """Conformity takes precedence over entropy; low values of both call for a look at the case."""
    return F.when(conformity_high, "confirmed").when(~entropy_high, "anomalous").otherwise("disconfirmed")
