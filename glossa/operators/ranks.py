"""Global ranks, ids and exact quantiles without a single-task sort.

Rows are first collapsed to distinct values with counts, so a value that holds a
third of all rows is one row from then on. Approximate cut points only balance
the buckets; ranks and quantiles themselves are exact: rank inside the bucket
plus the row count of the buckets below.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import null_safe_join

# Fewest buckets; beyond, their number follows the shuffle partitions.
MIN_BUCKETS = 16


def bucket_count(df: DataFrame) -> int:
    """Power of two near the session's shuffle partitions, so that a bucket is about a task's share."""
    wanted = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return 1 << max(MIN_BUCKETS, wanted).bit_length() - 1


def _bucket(cuts: str, value: str, buckets: int) -> Column:
    """Number of sorted cut points below the value, by halving steps.

    The value enters as an argument, not through the closure of the inner function:
    with only a scalar subquery beside it, Spark would take the expression to use
    no column and move it to the wrong side of a join.
    """
    steps = F.array(*[F.lit(buckets >> i) for i in range(1, buckets.bit_length())])

    def search(v: Column) -> Column:
        return F.aggregate(
            steps, F.lit(0), lambda at, step: F.when(F.element_at(F.col(cuts), at + step) < v, at + step).otherwise(at)
        )

    # Never null, or a join on it would filter on the search before the values are counted.
    return F.coalesce(F.transform(F.array(value), search)[0], F.lit(0))


def value_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Distinct values with their row counts ``n``; nulls are left out."""
    return df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))


def cumulative(counts: DataFrame, keys: Sequence[str], value: str, buckets: int | None = None) -> DataFrame:
    """Add ``before`` (rows with a smaller value under the same key) and ``total`` (rows under the key).

    No window holds more than one bucket of distinct values, or the ``buckets``
    totals of one key.
    """
    keys = list(keys)
    buckets = buckets or bucket_count(counts)
    cut = F.percentile_approx(value, [i / buckets for i in range(1, buckets)], 4 * buckets).alias("_cuts")
    # Asking for n keeps it in the plan, so that the counting shuffle is made once and reused.
    present = counts.filter(F.col("n") > 0)
    if keys:
        placed = null_safe_join(counts, present.groupBy(*keys).agg(cut), keys)
    else:
        placed = counts.withColumn("_cuts", present.agg(cut).scalar())
    placed = placed.withColumn("_bucket", _bucket("_cuts", value, buckets)).drop("_cuts")

    sums = placed.groupBy(*keys, "_bucket").agg(F.sum("n").alias("_rows"))
    by_key = Window.partitionBy(*keys)
    below = F.sum("_rows").over(by_key.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sums.select(
        *keys,
        "_bucket",
        F.coalesce(below, F.lit(0)).alias("_offset"),
        F.sum("_rows").over(by_key).alias("total"),
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    numbered = placed.withColumn("_inside", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    joined = null_safe_join(numbered, offsets, [*keys, "_bucket"])
    return joined.select(*counts.columns, (F.col("_offset") + F.col("_inside")).alias("before"), "total")


def average_ranks(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Average rank of each distinct value (ties share the mean of their positions)."""
    return average_ranks_of(value_counts(df, keys, value), value, keys)


def average_ranks_of(counts: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    ranked = cumulative(counts, keys, value)
    return ranked.select(*keys, value, "n", (F.col("before") + (F.col("n") + 1) / 2).alias("rank"))


def quantiles(df: DataFrame, keys: Sequence[str], value: str, probabilities: dict[str, float]) -> DataFrame:
    """Exact quantiles per key, interpolated linearly between neighbouring values."""
    return quantiles_of(cumulative(value_counts(df, keys, value), keys, value), keys, value, probabilities)


def quantiles_of(ranked: DataFrame, keys: Sequence[str], value: str, probabilities: dict[str, float]) -> DataFrame:
    def value_at(position: Column) -> Column:
        here = (F.col("before") <= position) & (position < F.col("before") + F.col("n"))
        return F.max(F.when(here, F.col(value)))

    wanted = []
    for name, p in probabilities.items():
        place = (F.col("total") - 1) * F.lit(float(p))
        wanted += [value_at(F.floor(place)).alias(f"_lo_{name}"), value_at(F.ceil(place)).alias(f"_hi_{name}")]
    picked = ranked.groupBy(*keys).agg(F.sum("n").alias("n"), *wanted)
    values = []
    for name, p in probabilities.items():
        place = (F.col("n") - 1) * F.lit(float(p))
        low, high = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        values.append((low + (place - F.floor(place)) * (high - low)).alias(name))
    return picked.select(*keys, "n", *values)


def box_summary(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Box-plot numbers per key: quartiles, whiskers at the last value within 1.5 IQR, outlier count."""
    ranked = cumulative(value_counts(df, keys, value), keys, value)
    box = quantiles_of(ranked, keys, value, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    reach = F.lit(1.5) * (F.col("q3") - F.col("q1"))
    inside = F.col(value).between(F.col("q1") - reach, F.col("q3") + reach)
    box = box.withColumnRenamed("n", "n_total")
    fenced = null_safe_join(ranked.select(*keys, value, "n"), box, list(keys)) if keys else ranked.select(value, "n").withColumns(
        {c: box.select(c).scalar() for c in ("q1", "median", "q3", "n_total")}
    )
    return fenced.groupBy(*keys, "q1", "median", "q3", F.col("n_total").alias("n")).agg(
        F.min(F.when(inside, F.col(value))).alias("whisker_low"),
        F.max(F.when(inside, F.col(value))).alias("whisker_high"),
        F.coalesce(F.sum(F.when(~inside, F.col("n"))), F.lit(0)).alias("n_outliers"),
    )


# Values that are drawn to cut an order into buckets, on average.
CUTS = 1024


def running_totals(counts: DataFrame, order: str, n: str = "n") -> DataFrame:
    """Add ``before``, the sum of ``n`` over the rows whose ``order`` is smaller; ``order`` is distinct and of any type with an order.

    A prefix sum without a window over the whole table: values drawn by their hash, about ``CUTS`` of them, cut the order into
    buckets; each bucket adds up its own rows, and the buckets' totals, one array of bounded size, carry the sums over. The null
    value comes first. How the draw falls changes how even the buckets are, never the sums.
    """
    value = F.col(f"`{order}`")
    rows = counts.agg(F.count(F.lit(1))).scalar()
    drawn = counts.where(F.pmod(F.xxhash64(value), F.greatest(F.lit(1), F.floor(rows / CUTS))) == 0)
    cuts = drawn.agg(F.array_sort(F.collect_set(value))).scalar()
    placed = counts.withColumn("_cuts", cuts).withColumn("_bucket", _below("_cuts", order)).drop("_cuts")
    inside = Window.partitionBy("_bucket").orderBy(F.asc_nulls_first(value)).rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy("_bucket").agg(F.sum(n).alias("_sum"))
    carried = sums.agg(F.array_sort(F.collect_list(F.struct("_bucket", "_sum")))).scalar()
    numbered = placed.withColumn("_inside", F.coalesce(F.sum(n).over(inside), F.lit(0))).withColumn("_carried", carried)
    earlier = lambda at: F.aggregate(
        F.filter("_carried", lambda x: x["_bucket"] < at), F.lit(0).cast("long"), lambda a, x: a + x["_sum"]
    )
    offset = F.transform(F.array("_bucket"), earlier)[0]
    return numbered.select(*[F.col(f"`{c}`") for c in counts.columns], (F.col("_inside") + offset).alias("before"))


def _below(cuts: str, value: str) -> Column:
    """Number of sorted cuts below the value, by halving steps; a null value has none."""
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(4 + CUTS.bit_length()))])
    get = lambda at: F.get(F.col(cuts), at - 1)

    def search(v: Column) -> Column:
        return F.aggregate(steps, F.lit(0), lambda at, step: F.when(get(at + step) < v, at + step).otherwise(at))

    return F.coalesce(F.transform(F.array(F.col(f"`{value}`")), search)[0], F.lit(0))


def item_ids(df: DataFrame, stratum_order: Column, order: str, prefix: str, digits: int = 3) -> DataFrame:
    """Number rows by stratum and then by the numeric column ``order``: ``prefix_001``, ``prefix_002``, …

    One row out per row in. A null stratum comes first, as a stratum of its own; rows of one stratum and order are numbered by
    a hash of the row; a row without order gets no id and takes no number.
    """
    keyed = df.withColumn("_stratum", stratum_order)
    numbered = cumulative(value_counts(keyed, ["_stratum"], order), ["_stratum"], order)
    sizes = keyed.groupBy("_stratum").agg(F.count(order).alias("_size"))
    starts = running_totals(sizes, "_stratum", "_size").select("_stratum", F.col("before").alias("_start"))
    position = (F.col("_start") + F.col("before") + 1).alias("_position")
    ids = null_safe_join(numbered, starts, ["_stratum"]).select("_stratum", order, position)
    tied = Window.partitionBy("_stratum", order).orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]))
    label = F.concat(F.lit(f"{prefix}_"), F.lpad(F.col("_position").cast("string"), F.greatest(F.lit(digits), F.length(F.col("_position").cast("string"))), F.lit("0")))
    placed = null_safe_join(keyed, ids, ["_stratum", order], "left").withColumn("_position", F.col("_position") + F.row_number().over(tied) - 1)
    return placed.withColumn("item_id", label).drop("_stratum", "_position")
