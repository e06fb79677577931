"""Regression models whose heavy part is one distributed aggregation.

Rows are reduced to moments (least squares), to one row per group (mixed model)
or to cells (binomial model). What is left to solve has as many unknowns as the
model has terms; that small solve runs inside a task on the moment rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.keys import null_safe_join
from ..functions.tails import normal_two_sided, t_pvalue, t_two_sided
from ..session import kept, shared_dir
from .ranks import average_ranks_of

INTERCEPT = "Intercept"
# Rank correlation below which presets disagree, the gates of the judge
# calibration and the level at which the threshold model steps.
RHO_GATE, JUDGE_GATE, STEP_LEVEL = 0.85, 0.75, 2


def interactions(names: Sequence[str]) -> dict[str, Column]:
    """Main effects and all pairwise products."""
    terms = {name: F.col(name).cast("double") for name in names}
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            terms[f"{a}:{b}"] = F.col(a).cast("double") * F.col(b).cast("double")
    return terms


def hinge(x: str, knot: float) -> dict[str, Column]:
    """Terms of a piecewise linear model with one knot."""
    value = F.col(x).cast("double")
    return {x: value, f"{x}_above_{knot:g}": F.greatest(value - F.lit(knot), F.lit(0.0))}


def _design(df: DataFrame, y: str, terms: Mapping[str, Column], keep: Sequence[str]) -> tuple[DataFrame, list[str]]:
    names = [f"_x{i}" for i in range(len(terms))]
    columns = [c.cast("double").alias(n) for n, c in zip(names, terms.values())]
    return df.select(*keep, F.col(y).cast("double").alias("_y"), *columns).na.drop(subset=["_y", *names]), names


def _pairs(names: Sequence[str]) -> list[tuple[str, str]]:
    return [(a, b) for i, a in enumerate(names) for b in names[i:]]


def _cells(df: DataFrame, y: str, keys: Sequence[str], cells: Sequence[str]) -> DataFrame:
    """One row per combination of the cell columns: rows, mean and sum of squares of ``y``."""
    value = F.col(y).cast("double")
    return (
        df.na.drop(subset=[y, *cells])
        .groupBy(*keys, *cells)
        .agg(F.count(F.lit(1)).alias("_n"), F.avg(value).alias("_mean"), (F.var_pop(value) * F.count(F.lit(1))).alias("_within"))
    )


def _moments(
    df: DataFrame, y: str, terms: Mapping[str, Column], keys: Sequence[str], cells: Sequence[str] = ()
) -> DataFrame:
    """Rows, means and covariances of the terms and ``y`` (last) per key, the covariances over ``_pairs``.

    Spark's merging covariance needs no second pass to centre. Each row becomes one
    row per pair, which keeps the aggregation inside generated code whatever the
    number of terms. With ``cells``, the columns the terms are made of, rows are
    first counted into cells.
    """
    if cells:
        return _cell_moments(_cells(df, y, keys, cells), terms, keys)
    design, names = _design(df, y, terms, keys)
    columns = [*names, "_y"]
    sums = _long_pairs(design, columns, keys).groupBy(*keys, "_i").agg(
        F.count(F.lit(1)).alias("n"), F.avg("_a").alias("_m"), F.covar_pop("_a", "_b").alias("_c")
    )
    return _packed(sums, columns, keys)


def _long_pairs(rows: DataFrame, columns: Sequence[str], keep: Sequence[str]) -> DataFrame:
    entries = [
        F.struct(F.lit(i).alias("_i"), F.col(a).alias("_a"), F.col(b).alias("_b")) for i, (a, b) in enumerate(_pairs(columns))
    ]
    return rows.select(*keep, F.inline(F.array(*entries)))


def _packed(sums: DataFrame, columns: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """One row per key from one row per pair (mean of its first column, covariance)."""
    diagonal = [i for i, (a, b) in enumerate(_pairs(columns)) if a == b]
    ordered = F.array_sort(F.collect_list(F.struct("_i", "_m", "_c")))
    packed = sums.groupBy(*keys).agg(F.max("n").alias("n"), ordered.alias("_p"))
    return packed.select(
        *keys,
        "n",
        F.array(*[F.col("_p")[i]["_m"] for i in diagonal]).alias("means"),
        F.transform("_p", lambda e: e["_c"]).alias("cov"),
    )


def _cell_moments(cells: DataFrame, terms: Mapping[str, Column], keys: Sequence[str]) -> DataFrame:
    """The same moments from cells. ``y`` is shifted by its overall mean against cancellation."""
    shift = cells.agg(F.sum(F.col("_n") * F.col("_mean")) / F.sum("_n")).scalar()
    names = [f"_x{i}" for i in range(len(terms))]
    columns = [*names, "_y"]
    rows = cells.select(
        *keys,
        "_n",
        "_within",
        *[c.cast("double").alias(n) for n, c in zip(names, terms.values())],
        (F.col("_mean") - shift).alias("_y"),
    )
    last = len(_pairs(columns)) - 1
    n = F.sum("_n")
    mean_a, mean_b = F.sum(F.col("_n") * F.col("_a")) / n, F.sum(F.col("_n") * F.col("_b")) / n
    product = F.sum(F.col("_n") * F.col("_a") * F.col("_b") + F.when(F.col("_i") == last, F.col("_within")).otherwise(0.0)) / n
    sums = _long_pairs(rows, columns, [*keys, "_n", "_within"]).groupBy(*keys, "_i").agg(
        n.alias("n"), mean_a.alias("_m"), (product - mean_a * mean_b).alias("_c")
    )
    unshifted = F.when(F.col("_i") == last, F.col("_m") + shift).otherwise(F.col("_m"))
    return _packed(sums.withColumn("_m", unshifted), columns, keys)


def _symmetric(values: np.ndarray, size: int) -> np.ndarray:
    """Symmetric matrices from their upper triangles, one per leading index."""
    full = np.zeros((*values.shape[:-1], size, size))
    rows, columns = np.triu_indices(size)
    full[..., rows, columns] = values
    full[..., columns, rows] = values
    return full


_COEFFICIENTS = [
    T.StructField("term", T.StringType()),
    T.StructField("coef", T.DoubleType()),
    T.StructField("se", T.DoubleType()),
    T.StructField("stat", T.DoubleType()),
    T.StructField("p", T.DoubleType()),
]
_FIT = [
    T.StructField("n", T.LongType()),
    T.StructField("r2", T.DoubleType()),
    T.StructField("sigma2", T.DoubleType()),
    T.StructField("aic", T.DoubleType()),
    T.StructField("bic", T.DoubleType()),
]


def _finite(value: float) -> float | None:
    return float(value) if math.isfinite(value) else None


def ols(
    df: DataFrame, y: str, terms: Mapping[str, Column], keys: Sequence[str] = (), cells: Sequence[str] = ()
) -> DataFrame:
    """Ordinary least squares with intercept, one fit per key: a row per term with its test, and the fit's AIC.

    ``AIC = n (ln 2π + ln(SSR/n) + 1) + 2k`` with k coefficients, the intercept included.
    Collinear terms share their effect as under the pseudo-inverse. ``cells`` names
    the columns the terms are made of where these take few values.
    """
    keys, labels = list(keys), [INTERCEPT, *terms]
    size = len(terms)
    schema = T.StructType([*df.select(*keys).schema.fields, *_COEFFICIENTS, *_FIT])

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            n = batch["n"].to_numpy(float)
            means = np.stack([np.array(m, float) for m in batch["means"]])
            cov = _symmetric(np.stack([np.array(c, float) for c in batch["cov"]]), size + 1)
            sxy, syy = cov[:, :-1, -1], cov[:, -1, -1]
            inverse = np.linalg.pinv(cov[:, :-1, :-1], hermitian=True)
            rank = np.linalg.matrix_rank(inverse, hermitian=True) if size else np.zeros(len(n))
            slopes = np.einsum("kij,kj->ki", inverse, sxy)
            explained = np.einsum("ki,ki->k", slopes, sxy)
            residual, dof = np.maximum(syy - explained, 0.0) * n, n - rank - 1
            means, ymean = means[:, :-1], means[:, -1]
            coefs = np.column_stack([ymean - np.einsum("ki,ki->k", means, slopes), slopes])
            spread = np.column_stack([1.0 + np.einsum("ki,kij,kj->k", means, inverse, means), np.diagonal(inverse, axis1=1, axis2=2)])
            with np.errstate(divide="ignore", invalid="ignore"):
                sigma2 = np.where(dof > 0, residual / dof, np.nan)
                se = np.sqrt(spread * (sigma2 / n)[:, None])
                t = np.where(se > 0, coefs / se, np.nan)
                likelihood = np.where(residual > 0, n * (math.log(2 * math.pi) + np.log(residual / n) + 1), np.nan)
                r2 = np.where(syy > 0, explained / syy, np.nan)
            each = size + 1
            out = {k: np.repeat(batch[k].to_numpy(), each) for k in keys}
            out |= {"term": labels * len(n), "coef": coefs.ravel(), "se": se.ravel(), "stat": t.ravel()}
            out |= {"p": t_two_sided(t, dof[:, None]).ravel(), "n": np.repeat(n.astype("int64"), each)}
            fit = {"r2": r2, "sigma2": sigma2, "aic": likelihood + 2 * (rank + 1), "bic": likelihood + np.log(n) * (rank + 1)}
            out |= {k: np.repeat(v, each) for k, v in fit.items()}
            frame = pd.DataFrame(out, columns=schema.names)
            measured = ["se", "stat", "p", *fit]
            frame[measured] = frame[measured].where(np.isfinite(frame[measured])).astype("Float64")
            yield frame

    return _moments(df, y, terms, keys, cells).mapInPandas(solve, schema)


def coefficient_ranking(coefficients: DataFrame, terms: Sequence[str]) -> DataFrame:
    """The named terms by size of coefficient, largest first."""
    return coefficients.filter(F.col("term").isin(*terms)).orderBy(F.desc(F.abs("coef")), "term")


def linear_or_step(df: DataFrame, x: str, y: str, step_at: float = STEP_LEVEL) -> DataFrame:
    """AIC of the linear and of the step model, and which is lower.

    A perfect fit has no finite AIC (null) and wins; a step that the rows cannot show (all on one side of it) loses. Without rows
    that show a line there is no preference.

    Both are simple regressions, so one aggregation with Spark's own regression
    functions covers them.
    """
    rows = df.select(F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).na.drop()
    rows = rows.withColumn("_s", (F.col("_x") >= step_at).cast("double"))
    fits = rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.regr_slope("_y", "_x").alias("linear_slope"),
        F.regr_intercept("_y", "_x").alias("linear_intercept"),
        F.regr_r2("_y", "_x").alias("linear_r2"),
        F.regr_slope("_y", "_s").alias("step_height"),
        F.regr_r2("_y", "_s").alias("step_r2"),
        F.var_pop("_y").alias("_v"),
    )

    def aic(r2: str) -> Column:
        return F.col("n") * (F.log(F.lit(2 * math.pi)) + F.log(F.col("_v") * (1 - F.col(r2))) + 1) + 4

    scored = fits.withColumns({"linear_aic": aic("linear_r2"), "step_aic": aic("step_r2")}).drop("_v")
    linear = (F.col("linear_r2") >= 1) | F.col("step_r2").isNull() | (F.col("linear_aic") < F.col("step_aic"))
    step = (F.col("step_r2") >= 1) | (F.col("linear_aic") >= F.col("step_aic"))
    preferred = F.when(F.col("linear_r2").isNull(), F.lit(None)).when(linear, "linear").when(step, "threshold (step)")
    return scored.withColumn("preferred", preferred)


def regression_band(df: DataFrame, x: str, y: str, keys: Sequence[str] = ()) -> DataFrame:
    """Fitted line per key with what its confidence band needs: residual error, mean and spread of x."""
    rows = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    n = F.count(F.lit(1))
    residual = F.regr_syy(y, x) - F.pow(F.regr_sxy(y, x), 2) / F.regr_sxx(y, x)
    return rows.groupBy(*keys).agg(
        n.alias("n"),
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.when(n > 2, F.sqrt(F.greatest(residual, F.lit(0.0)) / (n - 2))).alias("residual_se"),
        F.avg(x).alias("x_mean"),
        F.regr_sxx(y, x).alias("x_ss"),
    )


# --- correlations -----------------------------------------------------------


def _with_t_test(df: DataFrame, r: str, dof: Column) -> DataFrame:
    t = F.when(F.abs(F.col(r)) < 1, F.col(r) * F.sqrt(dof / (1 - F.col(r) * F.col(r))))
    exact = F.when(F.abs(F.col(r)) >= 1, F.lit(0.0))
    return df.withColumn("t", t).withColumn("p", F.coalesce(t_pvalue(F.col("t"), dof.cast("double")), exact))


def spearman_matrix(df: DataFrame, columns: Sequence[str], gate: float = RHO_GATE, keys: Sequence[str] = ()) -> DataFrame:
    """Spearman's ρ of every pair of columns over complete rows, per key: average ranks, p-value, and whether ρ misses the gate.

    Equal rows are counted first; each column is ranked once, from the counted rows,
    and one aggregation of the ranked rows serves all pairs. A null key is a group of its own.
    """
    keys = list(keys)
    names = [f"_c{i}" for i in range(len(columns))]
    complete = df.select(*keys, *[F.col(c).alias(n) for c, n in zip(columns, names)]).na.drop(subset=names)
    counted = complete.groupBy(*keys, *names).agg(F.count(F.lit(1)).alias("w"))
    ranked = counted
    for i, name in enumerate(names):
        values = counted.groupBy(*keys, name).agg(F.sum("w").alias("n"))
        ranks = average_ranks_of(values, name, keys).select(*keys, name, F.col("rank").alias(f"_r{i}"))
        ranked = null_safe_join(ranked, ranks, [*keys, name])
    pairs = [(i, j) for i in range(len(names)) for j in range(i + 1, len(names))]
    w = F.col("w").cast("double")
    sums = ranked.groupBy(*keys).agg(
        F.sum("w").alias("n"),
        *[F.sum(w * F.col(f"_r{i}") * F.col(f"_r{j}")).alias(f"_s{i}_{j}") for i, j in pairs],
        *[F.sum(w * F.col(f"_r{i}") * F.col(f"_r{i}")).alias(f"_s{i}") for i in range(len(names))],
    )
    middle = F.col("n") * F.pow((F.col("n") + 1) / 2, 2)

    def rho(i: int, j: int) -> Column:
        sx, sy = F.col(f"_s{i}") - middle, F.col(f"_s{j}") - middle
        return F.when((sx > 0) & (sy > 0), (F.col(f"_s{i}_{j}") - middle) / F.sqrt(sx * sy))

    entries = [
        F.struct(F.lit(columns[i]).alias("a"), F.lit(columns[j]).alias("b"), rho(i, j).alias("rho")) for i, j in pairs
    ]
    tested = _with_t_test(sums.select(*keys, "n", F.inline(F.array(*entries))), "rho", F.col("n") - 2)
    return tested.select(*keys, "a", "b", "n", "rho", "t", "p", (F.col("rho") < gate).alias("unstable"))


def spearman(df: DataFrame, x: str, y: str, gate: float = RHO_GATE, keys: Sequence[str] = ()) -> DataFrame:
    """Spearman's ρ of two columns, per key."""
    return spearman_matrix(df, [x, y], gate, keys).drop("a", "b")


def preset_stability(pivoted: DataFrame, configs: Sequence[str]) -> DataFrame:
    """Spearman's ρ of every pair of presets."""
    return spearman_matrix(pivoted, configs).withColumnsRenamed({"a": "config_a", "b": "config_b"})


def partial_correlation(df: DataFrame, x: str, y: str, given: str, keys: Sequence[str] = ()) -> DataFrame:
    """Correlation of x and y given a third column, from three correlations of one aggregation."""
    rows = df.na.drop(subset=[x, y, given])
    stats = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.corr(x, y).alias("_xy"),
        F.corr(x, given).alias("_xz"),
        F.corr(y, given).alias("_yz"),
    )
    rest = (1 - F.col("_xz") * F.col("_xz")) * (1 - F.col("_yz") * F.col("_yz"))
    r = F.when(rest > 0, (F.col("_xy") - F.col("_xz") * F.col("_yz")) / F.sqrt(rest))
    tested = _with_t_test(stats.withColumn("r", r), "r", F.col("n") - 3)
    return tested.drop("_xy", "_xz", "_yz").withColumn("confirmed", (F.col("r") < 0) & (F.col("p") < 0.05))


def judge_gate(df: DataFrame, judge: str, expert: str, keys: Sequence[str] = (), gate: float = JUDGE_GATE) -> DataFrame:
    """Pearson's r of judge and expert scores; below the gate the judge is only a secondary measure."""
    scored = df.na.drop(subset=[judge, expert]).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.corr(judge, expert).alias("r")
    )
    return scored.withColumn("role", F.when(F.col("r") >= gate, "accepted").otherwise("demoted"))


# --- random-intercept model -------------------------------------------------


def _group_moments(df: DataFrame, y: str, terms: Mapping[str, Column], group: str, few: bool = False) -> tuple[DataFrame, list[str]]:
    """Moments per group as columns. ``few`` groups get them from one row per pair, which stays inside generated code; with
    many groups one wide row of sums per group moves less.
    """
    design, names = _design(df, y, terms, [group])
    columns = [*names, "_y"]
    if few:
        means = [F.col("means")[i].alias(f"m{c}") for i, c in enumerate(columns)]
        covariances = [F.col("cov")[i].alias(f"c{a}{b}") for i, (a, b) in enumerate(_pairs(columns))]
        return _moments(df, y, terms, [group]).select(group, "n", *means, *covariances), names
    return (
        design.groupBy(group).agg(
            F.count(F.lit(1)).alias("n"),
            *[F.avg(c).alias(f"m{c}") for c in columns],
            *[F.covar_pop(a, b).alias(f"c{a}{b}") for a, b in _pairs(columns)],
        ),
        names,
    )


def lmm_size_table(df: DataFrame, y: str, terms: Mapping[str, Column], group: str, few: bool = False) -> DataFrame:
    """Sufficient statistics of the random-intercept likelihood, one row per distinct group size.

    The likelihood weighs a group by θ/(1+nθ), which depends on its size n alone, so
    groups of one size can be added up before θ is known. There are at most √(2N)
    distinct sizes among N rows. Columns are centred at their overall means.

    ``w`` holds sums of squares and products over rows, ``b`` those of group totals;
    both run over the pairs of (1, terms…, y).
    """
    groups, names = _group_moments(df, y, terms, group, few)
    columns = [*names, "_y"]
    centre = groups.agg(
        F.struct(*[(F.sum(F.col("n") * F.col(f"m{c}")) / F.sum("n")).alias(c) for c in columns])
    ).scalar()
    centred = groups.withColumn("_centre", centre)
    deviation: dict[str, Column] = {"_one": F.lit(1.0)}
    deviation.update({c: F.col(f"m{c}") - F.col("_centre")[c] for c in columns})

    def within(a: str, b: str) -> Column:
        return F.lit(0.0) if a == "_one" else F.col(f"c{a}{b}")

    pairs = _pairs(["_one", *columns])
    rows = [F.sum(F.col("n") * (within(a, b) + deviation[a] * deviation[b])) for a, b in pairs]
    totals = [F.sum(F.col("n") * F.col("n") * deviation[a] * deviation[b]) for a, b in pairs]
    return centred.groupBy("n").agg(
        F.count(F.lit(1)).alias("n_groups"), F.array(*rows).alias("w"), F.array(*totals).alias("b"),
        F.max("_centre").alias("centre"),
    )


def lmm_profile(sizes: DataFrame, thetas: Column, n_pairs: int) -> DataFrame:
    """Cross products of the profile likelihood at each θ of an array expression; one row per θ."""
    shrink = F.col("theta") / (1 + F.col("n") * F.col("theta"))
    spread = sizes.withColumn("theta", F.explode(thetas))
    return spread.groupBy("theta").agg(
        F.sum(F.col("n") * F.col("n_groups")).alias("n_rows"),
        F.sum(F.col("n_groups") * F.log1p(F.col("n") * F.col("theta"))).alias("log_det"),
        F.array(*[F.sum(F.col("w")[i] - shrink * F.col("b")[i]) for i in range(n_pairs)]).alias("products"),
        F.max("centre").alias("centre"),
    )


def _gls(row: Mapping[str, object], size: int) -> tuple[np.ndarray, np.ndarray, float, float]:
    """Coefficients, their unscaled covariance, residual variance and deviance at one θ."""
    products = _symmetric(np.array(row["products"], float), size + 2)
    a, b, c = products[:-1, :-1], products[:-1, -1], products[-1, -1]
    inverse = np.linalg.pinv(a, hermitian=True)
    beta = inverse @ b
    n = int(row["n_rows"])
    sigma2 = max(float(c - b @ beta), 0.0) / n
    deviance = n * (math.log(2 * math.pi * sigma2) + 1) + float(row["log_det"]) if sigma2 > 0 else math.inf
    return beta, inverse, sigma2, deviance


# Logarithm of θ beyond which group and residual variance no longer tell apart in doubles.
WIDEST = 98.0


def lmm(
    df: DataFrame, y: str, terms: Mapping[str, Column], group: str, refinements: int = 3, points: int = 64, few: bool = False
) -> DataFrame:
    """Linear mixed model with one random intercept, by maximum likelihood.

    θ = σ²ᵤ/σ² is found on a logarithmic grid (zero included) that widens until the best
    point lies inside and then narrows around it. Fitting runs jobs when called: the rows are reduced to the
    group-size table, which is stored in the shared folder; each round aggregates
    that table and brings back one row of cross products per grid point. ``few`` says that
    there are many rows to a group, and only a handful of groups. One row per fixed effect, with the variance components and −2 log-likelihood of the fit.
    """
    spark, size, labels = df.sparkSession, len(terms), [INTERCEPT, *terms]
    n_pairs = (size + 2) * (size + 3) // 2
    path = shared_dir(spark, "group-sizes")
    lmm_size_table(df, y, terms, group, few).write.parquet(path)
    sizes = spark.read.parquet(path)

    def profile(thetas: Sequence[float]) -> list[tuple[float, dict]]:
        rows = lmm_profile(sizes, F.array(*[F.lit(float(t)) for t in thetas]), n_pairs).collect()
        return sorted(((_gls(r.asDict(), size)[3], r.asDict()) for r in rows), key=lambda e: (e[0], e[1]["theta"]))

    span, step = 14.0, 28.0 / points
    found = profile([0.0, *[math.exp(-span + step * i) for i in range(points + 1)]])
    if not found:
        raise ValueError("no complete rows to fit")
    deviance, best = found[0]
    # An optimum on the edge of the grid is no optimum: widen on that side until it lies inside.
    while best["theta"] > 0 and abs(math.log(best["theta"])) > span - step / 2 and span < WIDEST:
        side = math.copysign(step, math.log(best["theta"]))
        wider = profile([math.exp(math.log(best["theta"]) + side * i) for i in range(1, points + 1)])
        deviance, best = min([(deviance, best), wider[0]], key=lambda e: (e[0], e[1]["theta"]))
        span += step * points
    for _ in range(refinements if best["theta"] > 0 else 0):
        fine = 2 * step / points
        around = [best["theta"] * math.exp(fine * i - step) for i in range(points + 1)]
        (deviance, best), step = profile(around)[0], fine

    beta, inverse, sigma2, _ = _gls(best, size)
    centre = np.array(list(best["centre"]), float)
    # Back to the uncentred columns: only the intercept changes.
    shift = np.concatenate([[1.0], -centre[:-1]])
    variances = np.diag(inverse).copy()
    variances[0] = shift @ inverse @ shift
    coefs = beta.copy()
    coefs[0] = shift @ beta + centre[-1]
    out = []
    for label, coef, var in zip(labels, coefs, variances * sigma2):
        se = math.sqrt(var) if var >= 0 else math.nan
        z = coef / se if se > 0 else math.nan
        tests = (_finite(se), _finite(z), _finite(normal_two_sided(z)))
        parts = (float(best["theta"]), sigma2, float(best["theta"] * sigma2), _finite(deviance), int(best["n_rows"]))
        out.append((label, float(coef), *tests, *parts))
    schema = T.StructType(
        [*_COEFFICIENTS]
        + [T.StructField(n, T.DoubleType()) for n in ("theta", "sigma2", "sigma2_group", "deviance")]
        + [T.StructField("n", T.LongType())]
    )
    return spark.createDataFrame(out, schema)


# --- binomial model ---------------------------------------------------------


def binomial_cells(df: DataFrame, correct: str, factors: Sequence[str]) -> DataFrame:
    """Successes and trials per cell; a binomial fit on cells equals the fit on rows."""
    return (
        df.filter(F.col(correct).isNotNull())
        .groupBy(*factors)
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(correct).cast("bigint")).alias("successes"))
    )


def system_terms(system: str, levels: Sequence[str], depth: str, critical: str) -> dict[str, Column]:
    """Terms of ``C(system) * depth * critical``; the first level is the reference."""
    base = {f"{system}[{v}]": (F.col(system) == v).cast("double") for v in levels[1:]}
    d, c = F.col(depth).cast("double"), F.col(critical).cast("double")
    terms = {**base, depth: d}
    terms.update({f"{k}:{depth}": v * d for k, v in base.items()})
    terms[critical] = c
    terms.update({f"{k}:{critical}": v * c for k, v in base.items()})
    terms[f"{depth}:{critical}"] = d * c
    terms.update({f"{k}:{depth}:{critical}": v * d * c for k, v in base.items()})
    return terms


def binomial_glm(cells: DataFrame, terms: Mapping[str, Column]) -> DataFrame:
    """Logistic regression on cells (``n``, ``successes``), with Wald tests.

    Fitting is iterative, so it runs jobs when called. They read the cells from a copy stored in the shared folder, so the rows
    behind the cells are aggregated once. A cell enters as its share of successes with its trials as weight: as separate
    successes and failures, heavy cells would start the iteration far out and send it astray. Deviance, log-likelihood and AIC
    are those of the rows, each a trial of its own. ``status`` is ``unconverged`` when the rounds were used up, as for
    outcomes told apart without error; ``binomial_glm_by_key`` names the reason.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression

    names = [f"_x{i}" for i in range(len(terms))]
    n, k = F.col("n").cast("double"), F.col("successes").cast("double")
    rows = cells.select(*[c.cast("double").alias(x) for x, c in zip(names, terms.values())], n.alias("weight"), (k / n).alias("label"))
    rows = kept(rows.filter("weight > 0"), "cells")
    data = VectorAssembler(inputCols=names, outputCol="features").transform(rows).select("features", "label", "weight")
    rounds = 100
    model = GeneralizedLinearRegression(family="binomial", link="logit", weightCol="weight", tol=1e-10, maxIter=rounds).fit(data)
    summary = model.summary
    values = [float(model.intercept), *[float(v) for v in model.coefficients]]
    order = [len(names), *range(len(names))]
    errors = [summary.coefficientStandardErrors[i] for i in order]
    # The summary's deviance is from the cells' own shares; theirs from the rows is added.
    label = F.col("label")
    entropy = F.when(label.between(1e-300, 1 - 1e-16), label * F.ln(label) + (1 - label) * F.ln(1 - label)).otherwise(0.0)
    within = rows.agg(F.sum(F.col("weight") * entropy)).first()[0] or 0.0
    deviance = float(summary.deviance) - 2 * within
    status = "converged" if summary.numIterations < rounds else "unconverged"
    fit = (deviance, -deviance / 2, deviance + 2 * len(values), status)
    rows_out = []
    for term, coef, se in zip([INTERCEPT, *terms], values, errors):
        z = coef / se if se and se > 0 else math.nan
        rows_out.append((term, coef, float(se), _finite(z), _finite(normal_two_sided(z)), *fit))
    fields = [T.StructField(c, T.DoubleType()) for c in ("deviance", "log_likelihood", "aic")]
    schema = T.StructType([*_COEFFICIENTS, *fields, T.StructField("status", T.StringType())])
    return cells.sparkSession.createDataFrame(rows_out, schema)


# A fit whose linear predictor has passed FAR and still moves by more than MOVING a round has no finite optimum; one that moves
# by less than STILL has arrived. Below RANK (smallest eigenvalue of the scaled information at zero) the terms are collinear.
FAR, MOVING, STILL, RANK = 25.0, 0.1, 1e-8, 1e-10
_STEP = "coef array<double>, step array<double>, deviance double, se array<double>, stat array<double>, p array<double>, status string"


def _newton_step(size: int, start: bool):
    """Next step of every key in a batch from its packed sums: information, gradient, deviance, reach of the predictor and of the step."""

    @F.pandas_udf(_STEP)
    def solve(sums: pd.Series, tops: pd.Series, coefs: pd.Series, steps: pd.Series, before: pd.Series) -> pd.DataFrame:
        values = np.stack(sums.to_list())
        # the packed sums end with the gradient and the deviance
        info, gradient, deviance = _symmetric(values[:, : -size - 1], size), values[:, -size - 1 : -1], values[:, -1]
        reach, moved = np.stack(tops.to_list()).T
        coef, step, before = np.stack(coefs.to_list()), np.stack(steps.to_list()), before.to_numpy(float)
        scale = np.sqrt(np.maximum(np.diagonal(info, axis1=1, axis2=2), np.finfo(float).tiny))
        scaled = info / scale[:, :, None] / scale[:, None, :]
        inverse = np.linalg.pinv(scaled, rcond=1e-15, hermitian=True) / scale[:, :, None] / scale[:, None, :]
        worse = ~np.isnan(before) & (deviance > before + 1e-9 * (1 + np.abs(before)))
        status = np.full(len(values), None, object)
        if start:
            status[np.linalg.eigvalsh(scaled)[:, 0] < RANK] = "singular"
        else:
            status[~worse & (moved <= STILL)] = "converged"
            status[(reach > FAR) & (moved > MOVING)] = "separated"
        se = np.sqrt(np.maximum(np.diagonal(inverse, axis1=1, axis2=2), 0.0))
        stat = np.divide(coef, se, out=np.full_like(coef, np.nan), where=se > 0)
        p = np.vectorize(normal_two_sided, otypes=[float])(stat)
        # A step that made the fit worse is halved, any other is followed by the next.
        following = np.where(worse[:, None], -step / 2, np.einsum("kij,kj->ki", inverse, gradient))
        open_ = np.array([v is None for v in status])
        coef = np.where(open_[:, None], coef + following, coef)
        step = np.where(worse[:, None], step / 2, following)
        columns = (list(coef), list(step), np.where(worse, before, deviance), list(se), list(stat), list(p), status)
        return pd.DataFrame(dict(zip(("coef", "step", "deviance", "se", "stat", "p", "status"), columns)))

    return solve


def binomial_glm_by_key(cells: DataFrame, terms: Mapping[str, Column], keys: Sequence[str], rounds: int = 40) -> DataFrame:
    """Logistic regression on cells (``n``, ``successes``), one fit per key, with Wald tests and a ``status``.

    All keys take their Newton step together: a round is one aggregation of the stored cells of the keys that are still open,
    combined before the shuffle, and one row per key goes into the solve. Rounds run jobs when called and are written to the
    shared folder. ``converged`` fits carry figures; ``separated`` (no finite optimum: some outcome is told apart without
    error), ``singular`` (collinear terms, or one cell only) and ``unconverged`` fits (``rounds`` used up) have null figures.
    Cells with a null term or count, or without trials, are left out; a key without any other cell has no rows. A null key is
    a group of its own.
    """
    keys, labels = list(keys), [INTERCEPT, *terms]
    names = [f"_x{i}" for i in range(len(labels))]
    size = len(labels)
    columns = [F.lit(1.0).alias(names[0]), *[c.cast("double").alias(n) for n, c in zip(names[1:], terms.values())]]
    counts = [F.col("n").cast("double").alias("_n"), F.col("successes").cast("double").alias("_k")]
    rows = kept(cells.select(*keys, *columns, *counts).na.drop(subset=[*names, "_n", "_k"]).filter("_n > 0"), "key-cells")
    zeros = F.array(*[F.lit(0.0)] * size)
    state = rows.groupBy(*keys).agg(F.sum("_n").cast("bigint").alias("trials"))
    state = state.select(*keys, "trials", zeros.alias("coef"), zeros.alias("step"), F.lit(None).cast("double").alias("deviance"))

    def along(weights: str) -> Column:
        return sum((F.col(n) * F.col(weights)[i] for i, n in enumerate(names[1:], 1)), F.col(weights)[0])

    def advance(state: DataFrame, start: bool) -> DataFrame:
        placed = null_safe_join(rows, state.select(*keys, "coef", "step"), keys)
        placed = placed.select(*keys, *names, "_n", "_k", along("coef").alias("_eta"), F.abs(along("step")).alias("_moved"))
        fails = F.log1p(F.exp(-F.abs("_eta")))
        placed = placed.withColumns(
            {
                "_p": 1 / (1 + F.exp(-F.col("_eta"))),
                "_q": 1 / (1 + F.exp("_eta")),
                "_cost": 2 * (F.col("_n") * fails + F.col("_k") * F.greatest(-F.col("_eta"), F.lit(0.0))
                              + (F.col("_n") - F.col("_k")) * F.greatest("_eta", F.lit(0.0))),
            }
        )
        weight = F.col("_n") * F.col("_p") * F.col("_q")
        residual = F.col("_k") * F.col("_q") - (F.col("_n") - F.col("_k")) * F.col("_p")
        values = [weight * F.col(a) * F.col(b) for a, b in _pairs(names)] + [residual * F.col(n) for n in names] + [F.col("_cost")]
        tops = [F.abs("_eta"), F.col("_moved")]
        entries = [F.struct(F.lit(i).alias("_i"), v.alias("_v")) for i, v in enumerate([*values, *tops])]
        entry = placed.select(*keys, F.inline(F.array(*entries)))
        folded = entry.groupBy(*keys, "_i").agg(F.sum("_v").alias("_s"), F.max("_v").alias("_m"))
        packed = folded.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_i", "_s", "_m"))).alias("_all"))
        sums = F.transform(F.slice("_all", 1, len(values)), lambda e: e["_s"])
        largest = F.transform(F.slice("_all", len(values) + 1, len(tops)), lambda e: e["_m"])
        joined = null_safe_join(state, packed, keys)
        fit = _newton_step(size, start)(sums, largest, F.col("coef"), F.col("step"), F.col("deviance"))
        return joined.select(*keys, "trials", fit.alias("_fit")).select(*keys, "trials", "_fit.*")

    finished = []
    for turn in range(rounds):
        after = kept(advance(state, turn == 0), "key-fits")
        finished.append(after.filter(F.col("status").isNotNull()))
        state = after.filter(F.col("status").isNull())
        if state.isEmpty():
            break
    else:
        finished.append(state.withColumn("status", F.lit("unconverged")))
    fits = finished[0]
    for more in finished[1:]:
        fits = fits.unionByName(more)
    good = F.col("status") == "converged"
    per_term = F.inline(
        F.array(
            *[
                F.struct(F.lit(label).alias("term"), *[F.when(good, F.col(c)[i]).alias(c) for c in ("coef", "se", "stat", "p")])
                for i, label in enumerate(labels)
            ]
        )
    )
    deviance = F.when(good, F.col("deviance"))
    figures = [deviance.alias("deviance"), (-deviance / 2).alias("log_likelihood"), (deviance + 2 * size).alias("aic")]
    return fits.select(*keys, per_term, *figures, F.col("trials").alias("n"), "status")
