import math

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from glossa.operators import models as ops

from .conftest import rows


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(3)
    n = 300
    x, z = rng.normal(size=n), rng.integers(0, 2, n)
    g = rng.integers(0, 20, n)
    y = 1000 + 2 * x - z + 0.5 * x * z + rng.normal(size=20)[g] + rng.normal(size=n)
    data = [(int(a), float(b), int(c), float(d)) for a, b, c, d in zip(g, x, z, y)]
    return spark.createDataFrame(data, "g int, x double, z int, y double").cache(), (g, x, z, y)


def design(x, z):
    return np.column_stack([np.ones_like(x), x, z, x * z])


def by_term(fit):
    return {r["term"]: r for r in fit.collect()}


def test_ols_against_least_squares(frame):
    df, (g, x, z, y) = frame
    fit = by_term(ops.ols(df, "y", ops.interactions(["x", "z"])))
    X = design(x, z)
    beta, *_ = np.linalg.lstsq(X, y, rcond=None)
    res = y - X @ beta
    s2 = res @ res / (len(y) - 4)
    se = np.sqrt(np.diag(np.linalg.inv(X.T @ X)) * s2)
    for i, term in enumerate(["Intercept", "x", "z", "x:z"]):
        assert fit[term]["coef"] == pytest.approx(beta[i], rel=1e-8)
        assert fit[term]["se"] == pytest.approx(se[i], rel=1e-8)
    n = len(y)
    assert fit["x"]["aic"] == pytest.approx(n * (math.log(2 * math.pi) + math.log(res @ res / n) + 1) + 8, rel=1e-10)


def test_ols_p_values_against_spark(frame):
    df, _ = frame
    fit = by_term(ops.ols(df, "y", {"x": F.col("x"), "z": F.col("z")}))
    data = VectorAssembler(inputCols=["x", "z"], outputCol="f").transform(df)
    summary = LinearRegression(featuresCol="f", labelCol="y", solver="normal").fit(data).summary
    for i, term in enumerate(["x", "z", "Intercept"]):
        assert fit[term]["p"] == pytest.approx(summary.pValues[i], abs=1e-10)


def test_ols_paths_agree(spark):
    rng = np.random.default_rng(5)
    flags = rng.integers(0, 2, (400, 4))
    y = 50 + flags @ np.array([1.0, 2, 3, 4]) + rng.normal(size=400)
    data = [(*map(int, f), float(v)) for f, v in zip(flags, y)]
    df = spark.createDataFrame(data, "D int, R int, V int, C int, y double")
    terms = ops.interactions(["D", "R", "V", "C"])
    a = by_term(ops.ols(df, "y", terms))
    b = by_term(ops.ols(df, "y", terms, cells=["D", "R", "V", "C"]))
    for term in a:
        for field in ("coef", "se", "p", "aic", "r2"):
            assert a[term][field] == pytest.approx(b[term][field], rel=1e-7, abs=1e-12)


def test_ols_per_key_and_missing_values(frame):
    df, (g, x, z, y) = frame
    holed = df.withColumn("y", F.when(F.col("x") < 2, F.col("y")))
    got = {(r["z"], r["term"]): r["coef"] for r in ops.ols(holed, "y", {"x": F.col("x")}, ["z"]).collect()}
    for k in (0, 1):
        m = (z == k) & (x < 2)
        slope, intercept = np.polyfit(x[m], y[m], 1)
        assert got[k, "x"] == pytest.approx(slope, rel=1e-8)
        assert got[k, "Intercept"] == pytest.approx(intercept, rel=1e-8)


def dense_deviance(theta, g, X, y):
    V = np.eye(len(y)) + theta * (g[:, None] == g[None, :])
    Vi = np.linalg.inv(V)
    beta = np.linalg.solve(X.T @ Vi @ X, X.T @ Vi @ y)
    r = y - X @ beta
    s2 = r @ Vi @ r / len(y)
    return len(y) * (math.log(2 * math.pi * s2) + 1) + np.linalg.slogdet(V)[1], beta, s2, np.linalg.inv(X.T @ Vi @ X)


def test_lmm_against_the_dense_likelihood(frame):
    df, (g, x, z, y) = frame
    fit = by_term(ops.lmm(df, "y", ops.interactions(["x", "z"]), "g"))
    theta = fit["x"]["theta"]
    deviance, beta, s2, inverse = dense_deviance(theta, g, design(x, z), y)
    assert fit["x"]["deviance"] == pytest.approx(deviance, rel=1e-9)
    assert fit["x"]["sigma2"] == pytest.approx(s2, rel=1e-8)
    for i, term in enumerate(["Intercept", "x", "z", "x:z"]):
        assert fit[term]["coef"] == pytest.approx(beta[i], rel=1e-7, abs=1e-9)
        assert fit[term]["se"] == pytest.approx(math.sqrt(inverse[i, i] * s2), rel=1e-6)
    for other in (theta * 0.99, theta * 1.01, 0.0):
        assert dense_deviance(other, g, design(x, z), y)[0] > deviance


def test_lmm_without_group_effect_is_ols(spark):
    rng = np.random.default_rng(11)
    data = [(i % 10, float(v), float(2 * v + (-1) ** (i // 10))) for i, v in enumerate(rng.normal(size=100))]
    df = spark.createDataFrame(data, "g int, x double, y double")
    fit, plain = by_term(ops.lmm(df, "y", {"x": F.col("x")}, "g")), by_term(ops.ols(df, "y", {"x": F.col("x")}))
    assert fit["x"]["theta"] == 0.0
    assert fit["x"]["coef"] == pytest.approx(plain["x"]["coef"], rel=1e-9)


def test_group_sizes_collapse(frame):
    df, _ = frame
    sizes = ops.lmm_size_table(df, "y", {"x": F.col("x")}, "g")
    counts = df.groupBy("g").count()
    assert sizes.count() == counts.select("count").distinct().count()
    assert sizes.agg(F.sum("n_groups")).first()[0] == 20


def test_glm_cells_against_rows(spark):
    rng = np.random.default_rng(7)
    n = 1500
    s, d, c = rng.integers(0, 2, n), rng.integers(1, 4, n), rng.integers(0, 2, n)
    p = 1 / (1 + np.exp(-(0.3 + 0.5 * s - 0.2 * d + 0.4 * c - 0.3 * s * c)))
    k = (rng.random(n) < p).astype(int)
    data = [("ab"[i], int(j), int(m), int(v)) for i, j, m, v in zip(s, d, c, k)]
    df = spark.createDataFrame(data, "system string, depth int, critical int, correct int")
    cells = ops.binomial_cells(df, "correct", ["system", "depth", "critical"])
    assert cells.count() == 12
    fit = by_term(ops.binomial_glm(cells, ops.system_terms("system", ["a", "b"], "depth", "critical")))
    X = np.column_stack([np.ones(n), s, d, s * d, c, s * c, d * c, s * d * c]).astype(float)
    beta = np.zeros(8)
    for _ in range(50):
        mu = 1 / (1 + np.exp(-X @ beta))
        H = X.T @ (X * (mu * (1 - mu))[:, None])
        beta = beta + np.linalg.solve(H, X.T @ (k - mu))
    se = np.sqrt(np.diag(np.linalg.inv(H)))
    names = ["Intercept", "system[b]", "depth", "system[b]:depth", "critical", "system[b]:critical", "depth:critical", "system[b]:depth:critical"]
    for i, name in enumerate(names):
        assert fit[name]["coef"] == pytest.approx(beta[i], abs=1e-6)
        assert fit[name]["se"] == pytest.approx(se[i], rel=1e-5)


def test_glm_by_key_marks_what_has_no_fit(spark):
    """Ordinary keys (a null one too) equal the fit of one key; separated, collinear and short runs are marked, not guessed."""
    schema = "key string, x double, n long, successes long"
    plain = [(0.0, 40, 12), (1.0, 35, 15), (2.0, 50, 31), (5.0, 3, 3)]
    rows_in = [(k, x, n * m, s * m) for k, m in (("a", 1), (None, 1000)) for x, n, s in plain]
    rows_in += [("split", 0.0, 10, 0), ("split", 1.0, 10, 10), ("half", 0.0, 10, 4), ("half", 1.0, 10, 10)]
    rows_in += [("all", 0.0, 5, 5), ("all", 1.0, 6, 6), ("flat", 2.0, 9, 3), ("none", 1.0, 0, 0), ("a", None, 7, 7), ("a", 1.0, None, 2)]
    cells = spark.createDataFrame(rows_in, schema)
    got = ops.binomial_glm_by_key(cells, {"x": F.col("x")}, ["key"]).collect()
    status = {r["key"]: r["status"] for r in got}
    assert status == {"a": "converged", None: "converged", "split": "separated", "half": "separated", "all": "separated", "flat": "singular"}
    assert len(got) == 12
    for r in got:
        if r["status"] != "converged":
            assert [r[c] for c in ("coef", "se", "stat", "p", "deviance", "log_likelihood", "aic")] == [None] * 7
    for key, where in (("a", F.col("key") == "a"), (None, F.col("key").isNull())):
        data = cells.filter(where).na.drop(subset=["x", "n"]).toPandas()
        X, n, k = np.column_stack([np.ones(len(data)), data["x"]]), data["n"].to_numpy(float), data["successes"].to_numpy(float)
        beta = np.zeros(2)
        for _ in range(30):
            mu = 1 / (1 + np.exp(-X @ beta))
            info = X.T @ (X * (n * mu * (1 - mu))[:, None])
            beta = beta + np.linalg.solve(info, X.T @ (k - n * mu))
        deviance = -2 * float(np.sum(k * np.log(mu) + (n - k) * np.log(1 - mu)))
        for i, term in enumerate(("Intercept", "x")):
            fit = next(r for r in got if r["key"] == key and r["term"] == term)
            assert fit["coef"] == pytest.approx(beta[i], rel=1e-7)
            assert fit["se"] == pytest.approx(np.sqrt(np.linalg.inv(info)[i, i]), rel=1e-6)
            assert (fit["deviance"], fit["aic"]) == (pytest.approx(deviance, rel=1e-9), pytest.approx(deviance + 4, rel=1e-9))
            assert fit["n"] == n.sum()
        sound = cells.filter(where).na.drop(subset=["x", "n"])
        alone = by_term(ops.binomial_glm(sound, {"x": F.col("x")}))
        assert (alone["x"]["status"], alone["x"]["deviance"]) == ("converged", pytest.approx(deviance, rel=1e-9))
        assert alone["x"]["coef"] == pytest.approx(beta[1], rel=1e-7)
    short = ops.binomial_glm_by_key(cells.filter("key = 'a'"), {"x": F.col("x")}, ["key"], rounds=2)
    assert {r["status"] for r in short.collect()} == {"unconverged"}
    assert ops.binomial_glm_by_key(cells.limit(0), {"x": F.col("x")}, ["key"]).count() == 0


def average_ranks(v):
    v = np.asarray(v)
    return np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])


def test_spearman_with_ties(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 6, 200)
    y = x + rng.integers(0, 9, 200)
    df = spark.createDataFrame([(int(a), int(b)) for a, b in zip(x, y)], "x int, y int")
    got = ops.spearman(df, "x", "y").first()
    rho = np.corrcoef(average_ranks(x), average_ranks(y))[0, 1]
    assert got["rho"] == pytest.approx(rho, rel=1e-12)
    assert got["unstable"] == (rho < 0.85)
    data = VectorAssembler(inputCols=["a"], outputCol="f").transform(
        spark.createDataFrame([(float(a), float(b)) for a, b in zip(average_ranks(x), average_ranks(y))], "a double, b double")
    )
    p = LinearRegression(featuresCol="f", labelCol="b", solver="normal").fit(data).summary.pValues[0]
    assert got["p"] == pytest.approx(p, abs=1e-10)


def test_spearman_of_a_constant_is_null(spark):
    got = ops.spearman(spark.createDataFrame([(1, i) for i in range(5)], "x int, y int"), "x", "y").first()
    assert got["rho"] is None and got["p"] is None


def test_partial_correlation_p_is_that_of_the_regression(frame):
    df, _ = frame
    got = ops.partial_correlation(df, "x", "y", "z").first()
    assert got["p"] == pytest.approx(by_term(ops.ols(df, "y", {"x": F.col("x"), "z": F.col("z")}))["x"]["p"], abs=1e-12)


def test_linear_against_step(spark):
    step = spark.createDataFrame([(l, float(l >= 2) + 0.01 * ((-1) ** i)) for i, l in enumerate([0, 1, 2, 3] * 6)], "x int, y double")
    line = spark.createDataFrame([(l, l + 0.01 * ((-1) ** (i // 4))) for i, l in enumerate([0, 1, 2, 3] * 6)], "x int, y double")
    assert ops.linear_or_step(step, "x", "y").first()["preferred"] == "threshold (step)"
    got = ops.linear_or_step(line, "x", "y").first()
    assert got["preferred"] == "linear"
    fit = by_term(ops.ols(line, "y", {"x": F.col("x")}))
    assert got["linear_aic"] == pytest.approx(fit["x"]["aic"], rel=1e-9)


def test_hinge_terms(spark):
    df = spark.createDataFrame([(float(t), 2.0 - max(t - 0.8, 0.0)) for t in (0.2, 0.5, 0.8, 1.2, 1.6)], "t double, y double")
    fit = by_term(ops.ols(df, "y", ops.hinge("t", 0.8)))
    assert fit["t"]["coef"] == pytest.approx(0.0, abs=1e-9)
    assert fit["t_above_0.8"]["coef"] == pytest.approx(-1.0, abs=1e-9)


def test_coefficient_ranking(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", -3.0), ("c", 2.0)], "term string, coef double")
    assert [r[0] for r in ops.coefficient_ranking(df, ["a", "b"]).collect()] == ["b", "a"]


def test_judge_gate(spark):
    df = spark.createDataFrame([("a", i, float(i)) for i in range(5)] + [("b", i, float(i % 2)) for i in range(5)], "k string, j int, e double")
    assert [(r[0], r[3]) for r in rows(ops.judge_gate(df, "j", "e", ["k"]), "k")] == [("a", "accepted"), ("b", "demoted")]
