"""Regression and correlation queries on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import design, models, summaries
from . import experiments
from .conformity_queries import _SCORES as _CONFORMITY
from .conformity_queries import scored_vectors
from .registry import query, rounded, table, texts
from .summary_queries import _ENTROPY, _topics


def _gauss(xs: list[str], y: str, source: str) -> str:
    """SQL that solves the normal equations of ``y ~ 1 + xs`` by elimination on the augmented matrix [X'X | I | X'y]."""
    cols = ["1.0::double", *xs]
    p = len(cols)
    rows = []
    for i in range(p):
        unit = ", ".join("1.0::double" if j == i else "0.0::double" for j in range(p))
        prods = ", ".join(f"sum(({cols[i]}) * ({cols[j]}))::double" for j in range(p))
        rows.append(f"[{prods}, {unit}, sum(({cols[i]}) * ({y}))::double]")
    return f"""mom as (select [{', '.join(rows)}] as m, sum(({y}) * ({y}))::double as yy, count(*) as n from {source}),
    gj as (select 0 as k, m, yy, n, m as m0 from mom union all
        select k + 1, list_transform(m, lambda r, i: case when i = k + 1 then list_transform(r, lambda v: v / m[k + 1][k + 1])
            else list_transform(r, lambda v, j: v - r[k + 1] * m[k + 1][j] / m[k + 1][k + 1]) end), yy, n, m0 from gj where k < {p}),
    sol as (select list_transform(m, lambda r: r[-1]) as beta, list_transform(m, lambda r, i: r[{p} + i]) as inv, n,
               yy - list_sum(list_transform(m, lambda r, i: r[-1] * m0[i][-1])) as ssr from gj where k = {p})"""


def _report(labels: list[str]) -> str:
    names = ", ".join(f"'{v}'" for v in labels)
    p = len(labels)
    return f"""select unnest([{names}]) as term, round(unnest(beta), 6) as coef,
        round(unnest(list_transform(inv, lambda v: sqrt(v * ssr / (n - {p})))), 6) as se, n,
        round(n * (ln(2 * pi()) + ln(ssr / n) + 1) + 2 * {p}, 4) as aic from sol"""


_ROWS = """f as (select l_quantity as y, (l_returnflag = 'R')::int::double as d, (l_linestatus = 'O')::int::double as r,
    (l_tax > 0.04)::int::double as v, (l_discount > 0.05)::int::double as c from lineitem)"""
_PAIRED = ["d", "r", "v", "c", "d*r", "d*v", "d*c", "r*v", "r*c", "v*c"]
_PAIRED_NAMES = ["D", "R", "V", "C", "D:R", "D:V", "D:C", "R:V", "R:C", "V:C"]


def _factorial(spark, sf):
    factors = {
        "D": F.col("l_returnflag") == "R",
        "R": F.col("l_linestatus") == "O",
        "V": F.col("l_tax") > 0.04,
        "C": F.col("l_discount") > 0.05,
    }
    line = table(spark, sf, "lineitem").select("l_quantity", *[design.flag(c).alias(n) for n, c in factors.items()])
    return models.ols(line, "l_quantity", models.interactions(list(factors)), cells=list(factors))


def _brief(fit):
    return rounded(fit.select("term", "coef", "se", "n", F.round("aic", 4).alias("aic")))


@query("factorial_ols", f"with recursive {_ROWS}, {_gauss(_PAIRED, 'y', 'f')} {_report(['Intercept', *_PAIRED_NAMES])}")
def factorial_ols(spark, sf):
    return _brief(_factorial(spark, sf))


@query(
    "component_ranking",
    f"""with recursive {_ROWS}, {_gauss(_PAIRED, 'y', 'f')}, t as (select unnest(['Intercept', {', '.join(repr(n) for n in _PAIRED_NAMES)}]) as term, unnest(beta) as coef from sol)
        select term, round(coef, 6) as coef from t where term in ('D', 'R', 'V', 'C') order by abs(coef) desc, term""",
)
def component_ranking(spark, sf):
    return rounded(models.coefficient_ranking(_factorial(spark, sf), ["D", "R", "V", "C"]).select("term", "coef"))


@query("factorial_ols_rows", f"with recursive {_ROWS}, {_gauss(_PAIRED, 'y', 'f')} {_report(['Intercept', *_PAIRED_NAMES])}")
def factorial_ols_rows(spark, sf):
    # The same fit without cells, as for predictors of many values.
    line = texts(spark, sf, "lineitem").select(
        "l_quantity",
        design.flag(F.col("l_returnflag") == "R").alias("D"),
        design.flag(F.col("l_linestatus") == "O").alias("R"),
        design.flag(F.col("l_tax") > 0.04).alias("V"),
        design.flag(F.col("l_discount") > 0.05).alias("C"),
    )
    return _brief(models.ols(line, "l_quantity", models.interactions(["D", "R", "V", "C"])))


@query(
    "hinge",
    f"""with recursive h as (select l_extendedprice / 1000 as y, l_quantity as x, greatest(l_quantity - 25, 0.0) as k from lineitem),
        {_gauss(['x', 'k'], 'y', 'h')} {_report(['Intercept', 'l_quantity', 'l_quantity_above_25'])}""",
)
def hinge(spark, sf):
    line = table(spark, sf, "lineitem").withColumn("price", F.col("l_extendedprice") / 1000)
    return _brief(models.ols(line, "price", models.hinge("l_quantity", 25.0)))


@query(
    "ols_by_key",
    """select o_orderstatus, round(regr_slope(o_totalprice, year(o_orderdate)), 4) as coef, round(regr_r2(o_totalprice, year(o_orderdate)), 6) as r2,
          count(*) as n from orders group by 1""",
)
def ols_by_key(spark, sf):
    orders = table(spark, sf, "orders").withColumn("year", F.year("o_orderdate"))
    fit = models.ols(orders, "o_totalprice", {"year": F.col("year")}, ["o_orderstatus"])
    return rounded(fit.filter("term = 'year'").select("o_orderstatus", F.round("coef", 4).alias("coef"), "r2", "n"))


@query(
    "aic_compare",
    """with a as (select o_custkey as domain, 5 - left(o_orderpriority, 1)::int as level, avg(o_totalprice) as y from orders group by all),
        s as (select *, (level >= 2)::int as step from a),
        f as (select count(*) as n, regr_slope(y, level) as ls, regr_intercept(y, level) as li, regr_r2(y, level) as lr, regr_slope(y, step) as ss, regr_r2(y, step) as sr,
                var_pop(y) as v from s),
        g as (select *, n * (ln(2 * pi()) + ln(v * (1 - lr)) + 1) + 4 as la, n * (ln(2 * pi()) + ln(v * (1 - sr)) + 1) + 4 as sa from f)
       select n, round(ls, 4) as linear_slope, round(li, 4) as linear_intercept, round(lr, 6) as linear_r2, round(ss, 4) as step_height, round(sr, 6) as step_r2,
          round(la, 4) as linear_aic, round(sa, 4) as step_aic, case when la < sa then 'linear' else 'threshold (step)' end as preferred from g""",
)
def aic_compare(spark, sf):
    level = F.lit(5) - F.substring("o_orderpriority", 1, 1).cast("int")
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("domain"), level.alias("level"), "o_totalprice")
    means = summaries.mean_and_sem(orders, ["domain", "level"], "o_totalprice")
    result = models.linear_or_step(means, "level", "mean")
    wide = ["linear_slope", "linear_intercept", "step_height", "linear_aic", "step_aic"]
    return rounded(result.withColumns({c: F.round(c, 4) for c in wide}))


@query(
    "regression_band",
    """select l_returnflag, count(*) as n, round(regr_slope(l_extendedprice, l_quantity), 4) as slope, round(regr_intercept(l_extendedprice, l_quantity), 3) as intercept,
          round(sqrt((regr_syy(l_extendedprice, l_quantity) - regr_sxy(l_extendedprice, l_quantity) ** 2 / regr_sxx(l_extendedprice, l_quantity)) / (count(*) - 2)), 3) as residual_se,
          round(avg(l_quantity), 6) as x_mean, round(regr_sxx(l_extendedprice, l_quantity), 2) as x_ss from lineitem group by 1""",
)
def regression_band(spark, sf):
    band = models.regression_band(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"])
    places = {"slope": 4, "intercept": 3, "residual_se": 3, "x_ss": 2}
    return rounded(band.withColumns({c: F.round(c, n) for c, n in places.items()}))


@query(
    "spearman",
    """with r as (select rank() over (order by l_quantity) + (count(*) over (partition by l_quantity) - 1) / 2 as rx,
                  rank() over (order by l_extendedprice) + (count(*) over (partition by l_extendedprice) - 1) / 2 as ry from lineitem)
       select count(*) as n, round(corr(rx, ry), 6) as rho, corr(rx, ry) < 0.85 as unstable from r""",
)
def spearman(spark, sf):
    return rounded(models.spearman(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice").select("n", "rho", "unstable"))


@query(
    "spearman_by_key",
    """with l as (select nullif(l_returnflag, 'N') as judge, l_linenumber as a, l_tax as b, l_discount as c from lineitem),
        r as (select judge, rank() over (partition by judge order by a) + (count(*) over (partition by judge, a) - 1) / 2 as ra,
                rank() over (partition by judge order by b) + (count(*) over (partition by judge, b) - 1) / 2 as rb,
                rank() over (partition by judge order by c) + (count(*) over (partition by judge, c) - 1) / 2 as rc from l)
       select judge, 'l_linenumber' as a, 'l_tax' as b, count(*) as n, round(corr(ra, rb), 6) as rho from r group by 1
       union all select judge, 'l_linenumber', 'l_discount', count(*), round(corr(ra, rc), 6) from r group by 1
       union all select judge, 'l_tax', 'l_discount', count(*), round(corr(rb, rc), 6) from r group by 1""",
)
def spearman_by_key(spark, sf):
    # Scores of one judge given again, with a null judge among them.
    line = table(spark, sf, "lineitem").withColumn("judge", F.nullif("l_returnflag", F.lit("N")))
    columns = ["l_linenumber", "l_tax", "l_discount"]
    line = line.select("judge", *[F.col(c).cast("double").alias(c) for c in columns])
    return rounded(models.spearman_matrix(line, columns, keys=["judge"]).select("judge", "a", "b", "n", "rho"))


@query(
    "preset_stability",
    f"""with {_ENTROPY}, w as (select source, avg(entropy) filter (config = 'conservative') as a, avg(entropy) filter (config = 'default') as b,
              avg(entropy) filter (config = 'fine_grained') as c from ent group by 1),
        v as (select source, round(a, 9) as a, round(b, 9) as b, round(c, 9) as c from w),
        r as (select rank() over (order by a) + (count(*) over (partition by a) - 1) / 2 as ra, rank() over (order by b) + (count(*) over (partition by b) - 1) / 2 as rb,
                rank() over (order by c) + (count(*) over (partition by c) - 1) / 2 as rc from v)
        select 'conservative' as config_a, 'default' as config_b, count(*) as n, case when isnan(corr(ra, rb)) then null else round(corr(ra, rb), 6) end as rho from r
        union all select 'conservative', 'fine_grained', count(*), case when isnan(corr(ra, rc)) then null else round(corr(ra, rc), 6) end from r
        union all select 'default', 'fine_grained', count(*), case when isnan(corr(rb, rc)) then null else round(corr(rb, rc), 6) end from r""",
)
def preset_stability(spark, sf):
    pivoted = summaries.config_pivot(summaries.preset_entropy(_topics(spark, sf), ["source"], "topic"), ["source"])
    configs = list(summaries.TOPIC_PRESETS)
    # Entropies that only differ in their last bits count as tied.
    tied = pivoted.withColumns({c: F.round(c, 9) for c in configs})
    return rounded(models.preset_stability(tied, configs).select("config_a", "config_b", "n", "rho"))


@query(
    "partial_corr",
    """with e as (select min(l_extendedprice) a, max(l_extendedprice) b, min(l_quantity) e, max(l_quantity) f, min(l_tax) c, max(l_tax) d from lineitem),
        n as (select l_linestatus, l_linenumber as x, l_discount as z, ((l_extendedprice - a) / (b - a + 1e-9) + (l_tax - c) / (d - c + 1e-9)
                + (l_quantity - e) / (f - e + 1e-9)) / (l_discount * 100 + 1 + 1e-9) as y from lineitem, e),
        c as (select l_linestatus, count(*) as n, corr(x, y) as xy, corr(x, z) as xz, corr(y, z) as yz from n group by 1)
       select l_linestatus, n, round((xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)), 6) as r from c""",
)
def partial_corr(spark, sf):
    df = table(spark, sf, "lineitem").withColumn("quality", F.col("l_discount") * 100 + 1)
    effort = summaries.effort_to_quality(df, ["l_extendedprice", "l_tax", "l_quantity"], "quality")
    result = models.partial_correlation(effort, "l_linenumber", "effort_to_quality", "l_discount", ["l_linestatus"])
    return rounded(result.select("l_linestatus", "n", "r"))


@query(
    "judge_gate",
    """select l_returnflag, count(*) as n, round(corr(l_extendedprice, l_quantity), 6) as r,
          case when corr(l_extendedprice, l_quantity) >= 0.75 then 'accepted' else 'demoted' end as role from lineitem group by 1""",
)
def judge_gate(spark, sf):
    return rounded(models.judge_gate(table(spark, sf, "lineitem"), "l_extendedprice", "l_quantity", ["l_returnflag"]))


def _lmm_frame(spark, sf):
    orders = table(spark, sf, "orders").select(
        "o_custkey",
        (F.col("o_totalprice") / 100000).alias("quality"),
        (F.year("o_orderdate") - 1995).alias("generation"),
        design.flag(F.col("o_orderstatus") == "F").alias("kind"),
    )
    return orders, models.interactions(["generation", "kind"])


@query(
    "lmm_profile",
    """with r as (select o_custkey, o_totalprice / 100000 as y, (o_orderstatus = 'F')::int as x from orders),
        m as (select avg(y) as my, avg(x) as mx from r),
        g as (select o_custkey, count(*) as n, sum(x - mx) as sx, sum(y - my) as sy, sum((x - mx) ** 2) as xx, sum((x - mx) * (y - my)) as xy, sum((y - my) ** 2) as yy
              from r, m group by 1),
        t as (select unnest([0.0, 0.001, 0.01, 0.1, 1.0]::double[]) as theta),
        p as (select theta, sum(n) as n_rows, sum(ln(1 + n * theta)) as log_det, sum(n - theta / (1 + n * theta) * n * n) as oo, sum(sx - theta / (1 + n * theta) * n * sx) as ox,
                sum(sy - theta / (1 + n * theta) * n * sy) as oy, sum(xx - theta / (1 + n * theta) * sx * sx) as xx, sum(xy - theta / (1 + n * theta) * sx * sy) as xy,
                sum(yy - theta / (1 + n * theta) * sy * sy) as yy from g, t group by 1)
       select theta, n_rows::bigint as n_rows, round(log_det, 6) as log_det, round(oo, 6) as oo, round(ox, 6) as ox, round(oy, 6) as oy, round(xx, 6) as xx, round(xy, 6) as xy,
          round(yy, 5) as yy from p""",
)
def lmm_profile(spark, sf):
    orders, _ = _lmm_frame(spark, sf)
    sizes = models.lmm_size_table(orders, "quality", {"kind": F.col("kind")}, "o_custkey")
    grid = F.array(*[F.lit(t) for t in (0.0, 0.001, 0.01, 0.1, 1.0)])
    profile = models.lmm_profile(sizes, grid, 6)
    names = ["oo", "ox", "oy", "xx", "xy", "yy"]
    out = profile.select("theta", "n_rows", "log_det", *[F.col("products")[i].alias(n) for i, n in enumerate(names)])
    return rounded(out.withColumn("yy", F.round("yy", 5)))


def _lmm_sql(rows: str, xs: list[str], refinements: int = 3, points: int = 64) -> str:
    """SQL of ``y ~ 1 + xs + (1 | grp)`` over CTEs that define ``r``: the narrowing θ grid, solved by elimination for every θ."""
    z = ["1.0::double", *[f"({x} - m_{x})" for x in xs], "(y - m_y)"]
    p = len(z) - 1
    pairs = [(i, j) for i in range(p + 1) for j in range(i, p + 1)]
    unit = lambda i: ", ".join("1.0::double" if j == i else "0.0::double" for j in range(p))
    shrunk = ", ".join(f"sum(w{i}_{j} - theta / (1 + n * theta) * s{i} * s{j}) as p{i}_{j}" for i, j in pairs)
    entry = lambda i, j: f"p{min(i, j)}_{max(i, j)}"
    matrix = ", ".join(f"[{', '.join(entry(i, j) for j in range(p))}, {unit(i)}, {entry(i, p)}]" for i in range(p))
    step = 28.0 / points
    grid = f"select 0.0::double as theta union all select exp(-14 + {step!r} * unnest(range({points + 1})))"
    rounds = []
    for k in range(refinements + 1):
        rounds.append(f"""grid{k} as ({grid}),
        prod{k} as (select theta, sum(n) as nn, sum(ln(1 + n * theta)) as ld, {shrunk} from g, grid{k} group by 1),
        gj{k} as (select theta, nn, ld, {entry(p, p)} as yy, 0 as k, [{matrix}] as m, [{', '.join(entry(i, p) for i in range(p))}] as xy from prod{k}
          union all select theta, nn, ld, yy, k + 1, list_transform(m, lambda r, i: case when i = k + 1 then list_transform(r, lambda v: v / m[k + 1][k + 1])
            else list_transform(r, lambda v, j: v - r[k + 1] * m[k + 1][j] / m[k + 1][k + 1]) end), xy from gj{k} where k < {p}),
        fit{k} as (select theta, nn, ld, list_transform(m, lambda r: r[-1]) as beta, list_transform(m, lambda r: r[{p + 1}:{2 * p}]) as inv,
            (yy - list_sum(list_transform(m, lambda r, i: r[-1] * xy[i]))) / nn as s2 from gj{k} where k = {p}),
        best{k} as (select *, nn * (ln(2 * pi() * s2) + 1) + ld as dev from fit{k} order by dev, theta limit 1)""")
        fine = 2 * step / points
        grid = f"select distinct theta * exp({fine!r} * unnest(range({points + 1})) - {step!r}) as theta from best{k}"
        step = fine
    shift = ", ".join(["1.0::double", *[f"-m_{x}" for x in xs]])
    names = ", ".join(repr(n) for n in ["Intercept", *xs])
    return f"""{rows},
        m as (select avg(y) as m_y, {', '.join(f'avg({x}) as m_{x}' for x in xs)} from r),
        g as (select grp, count(*) as n, {', '.join(f'sum({c}) as s{i}' for i, c in enumerate(z))}, {', '.join(f'sum({z[i]} * {z[j]}) as w{i}_{j}' for i, j in pairs)}
              from r, m group by 1), {', '.join(rounds)},
        u as (select *, [{shift}] as shift from best{refinements}, m),
        v as (select *, list_sum(list_transform(inv, lambda r, i: shift[i] * list_sum(list_transform(r, lambda x, j: x * shift[j])))) as v0 from u)
        select unnest([{names}]) as term, round(unnest(list_transform(beta, lambda b, i: case when i = 1 then list_dot_product(beta, shift) + m_y else b end)), 5) as coef,
          round(unnest(list_transform(inv, lambda r, i: sqrt(s2 * case when i = 1 then v0 else r[i] end))), 5) as se,
          round(s2, 5) as sigma2, round(theta * s2, 3) as sigma2_group, round(dev, 4) as deviance, nn::bigint as n from v"""


def _mixed(fit):
    places = {"coef": 5, "se": 5, "sigma2": 5, "sigma2_group": 3, "deviance": 4}
    return rounded(fit.select("term", *[F.round(c, n).alias(c) for c, n in places.items()], "n"))


@query(
    "lmm_slope",
    _lmm_sql(
        f"with recursive {_CONFORMITY}, r as (select label as grp, conformity * 10 as y, list_sum(list_transform(embedding::double[], lambda v: abs(v))) as x from scored join embeddings using (vec_id, label))",
        ["x"],
    ),
)
def lmm_slope(spark, sf):
    # Conformity and absolute sum, both of whole vectors.
    size = F.aggregate("embedding", F.lit(0.0), lambda a, v: a + F.abs(v.cast("double")))
    vectors = scored_vectors(spark, sf).select("label", (F.col("conformity") * 10).alias("y"), size.alias("x"))
    return _mixed(models.lmm(vectors, "y", {"x": F.col("x")}, "label"))


@query(
    "lmm",
    _lmm_sql(
        """with recursive r as (select o_custkey as grp, o_totalprice / 100000 as y, (year(o_orderdate) - 1995)::double as generation, (o_orderstatus = 'F')::int::double as kind,
             (year(o_orderdate) - 1995) * (o_orderstatus = 'F')::int::double as ab from orders)""",
        ["generation", "kind", "ab"],
    ).replace("'ab'", "'generation:kind'"),
)
def lmm(spark, sf):
    orders, terms = _lmm_frame(spark, sf)
    return _mixed(models.lmm(orders, "quality", terms, "o_custkey"))


def _entropy_sql(rows: str, a: str, b: str) -> str:
    """``rows`` has grp, two predictors and topic; the entropy of the topics is the outcome."""
    made = f"""with recursive t as ({rows}), c as (select grp, {a}, {b}, topic, count(*) as k from t group by all),
        s as (select *, k / sum(k) over (partition by grp, {a}, {b}) as p from c),
        r as (select grp, {a}::double as {a}, {b}::double as {b}, ({a} * {b})::double as ab, round(sum(-p * log2(p)), 9) as y from s group by grp, {a}, {b})"""
    return _lmm_sql(made, [a, b, "ab"]).replace("'ab'", f"'{a}:{b}'")


@query(
    "entropy_charge_model",
    _entropy_sql("select l_suppkey as grp, (l_suppkey % 3 = 0)::int as charged, (l_tax * 10)::double as temperature, l_linenumber as topic from lineitem", "charged", "temperature"),
)
def entropy_charge_model(spark, sf):
    topics = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("concept_id"),
        F.when(F.col("l_suppkey") % 3 == 0, "charged").otherwise("control").alias("concept_type"),
        (F.col("l_tax") * 10).alias("temperature"),
        F.col("l_linenumber").alias("topic"),
    )
    entropies = summaries.topic_entropy(topics, ["concept_id", "concept_type", "temperature"], "topic")
    return _mixed(experiments.charge_model(entropies.withColumn("entropy", F.round("entropy", 9))))


@query(
    "entropy_generation_model",
    _entropy_sql(
        "select o_custkey as grp, (year(o_orderdate) % 4 + 1) as generation_ord, (o_custkey % 2 = 1)::int as changing, o_orderpriority as topic from orders",
        "generation_ord",
        "changing",
    ),
)
def entropy_generation_model(spark, sf):
    topics = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("concept"),
        F.when(F.col("o_custkey") % 2 == 1, "changing").otherwise("stable").alias("concept_type"),
        F.concat(F.lit("gen"), F.year("o_orderdate") % 4 + 1).alias("generation"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("topic"),
    )
    entropies = summaries.topic_entropy(topics, ["concept", "concept_type", "generation"], "topic")
    return _mixed(experiments.generation_model(entropies.withColumn("entropy", F.round("entropy", 9))))


def _glm_cells(spark, sf):
    line = table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("system"),
        ((F.col("l_linenumber") - 1) % 3 + 1).alias("depth"),
        design.flag(F.col("l_tax") > 0.04).alias("critical"),
        design.flag(F.col("l_quantity") + 4 * F.col("l_linenumber") > 36).alias("correct"),
    )
    return models.binomial_cells(line, "correct", ["system", "depth", "critical"])


# The full three-way model is one two-parameter fit per (system, critical), so Newton steps per group solve it.
_GLM = """with recursive c as (select l_returnflag as system, ((l_linenumber - 1) % 3 + 1) as depth, (l_tax > 0.04)::int as critical,
        count(*)::double as n, sum((l_quantity + 4 * l_linenumber > 36)::int)::double as k from lineitem group by all),
    grp as (select system, critical, list(depth::double) as d, list(n) as n, list(k) as k from c group by all),
    it as (select system, critical, d, n, k, 0 as step, 0.0::double as a, 0.0::double as b from grp
      union all
      select system, critical, d, n, k, step + 1, a + (s2 * g1 - s1 * g2) / (s0 * s2 - s1 * s1), b + (s0 * g2 - s1 * g1) / (s0 * s2 - s1 * s1)
      from (select *, list_sum(w) as s0, list_sum(list_transform(w, lambda v, i: v * d[i])) as s1, list_sum(list_transform(w, lambda v, i: v * d[i] * d[i])) as s2,
                list_sum(list_transform(p, lambda v, i: k[i] - n[i] * v)) as g1, list_sum(list_transform(p, lambda v, i: (k[i] - n[i] * v) * d[i])) as g2
            from (select *, list_transform(p, lambda v, i: n[i] * v * (1 - v)) as w
                  from (select *, list_transform(d, lambda x: 1 / (1 + exp(-(a + b * x)))) as p from it where step < 30)))),
    f0 as (select *, list_transform(d, lambda x: 1 / (1 + exp(-(a + b * x)))) as p from it where step = 30),
    f1 as (select *, list_sum(list_transform(p, lambda v, i: n[i] * v * (1 - v))) as s0, list_sum(list_transform(p, lambda v, i: n[i] * v * (1 - v) * d[i])) as s1,
             list_sum(list_transform(p, lambda v, i: n[i] * v * (1 - v) * d[i] * d[i])) as s2 from f0),
    f as (select system, critical, a, b, s2 / (s0 * s2 - s1 * s1) as va, s0 / (s0 * s2 - s1 * s1) as vb,
            -2 * list_sum(list_transform(p, lambda v, i: k[i] * ln(v) + (n[i] - k[i]) * ln(1 - v))) as dev from f1),
    co as (select 'Intercept' as term, a as coef, va as v from f where system = 'A' and critical = 0
      union all select 'depth', b, vb from f where system = 'A' and critical = 0
      union all select 'system[' || f.system || ']', f.a - r.a, f.va + r.va from f, f r where f.critical = 0 and f.system <> 'A' and r.system = 'A' and r.critical = 0
      union all select 'system[' || f.system || ']:depth', f.b - r.b, f.vb + r.vb from f, f r where f.critical = 0 and f.system <> 'A' and r.system = 'A' and r.critical = 0
      union all select 'critical', f.a - r.a, f.va + r.va from f, f r where f.critical = 1 and f.system = 'A' and r.system = 'A' and r.critical = 0
      union all select 'depth:critical', f.b - r.b, f.vb + r.vb from f, f r where f.critical = 1 and f.system = 'A' and r.system = 'A' and r.critical = 0
      union all select 'system[' || f.system || ']:critical', f.a - g.a - h.a + r.a, f.va + g.va + h.va + r.va from f, f g, f h, f r where f.critical = 1
          and f.system <> 'A' and g.system = f.system and g.critical = 0 and h.system = 'A' and h.critical = 1 and r.system = 'A' and r.critical = 0
      union all select 'system[' || f.system || ']:depth:critical', f.b - g.b - h.b + r.b, f.vb + g.vb + h.vb + r.vb from f, f g, f h, f r where f.critical = 1
          and f.system <> 'A' and g.system = f.system and g.critical = 0 and h.system = 'A' and h.critical = 1 and r.system = 'A' and r.critical = 0)
    select term, round(coef, 5) as coef, round(sqrt(v), 5) as se, round(dev, 3) as deviance, round(-dev / 2, 3) as log_likelihood, round(dev + 24, 3) as aic
    from co, (select sum(dev) as dev from f)"""


@query("glm_cells", _GLM)
def glm_cells(spark, sf):
    fit = models.binomial_glm(_glm_cells(spark, sf), models.system_terms("system", ["A", "N", "R"], "depth", "critical"))
    figures = [F.round(c, 3).alias(c) for c in ("deviance", "log_likelihood", "aic")]
    return rounded(fit.select("term", F.round("coef", 5).alias("coef"), F.round("se", 5).alias("se"), *figures))


_GLM_BY_KEY = """with recursive c as (select l_suppkey, ((l_linenumber - 1) % 3 + 1) as depth, count(*)::double as n,
        sum((l_quantity + 4 * l_linenumber > 36)::int)::double as k from lineitem group by all),
    grp as (select l_suppkey, list(depth::double) as d, list(n) as n, list(k) as k from c group by all),
    it as (select l_suppkey, d, n, k, 0 as step, 0.0::double as a, 0.0::double as b from grp
      union all
      select l_suppkey, d, n, k, step + 1, a + (s2 * g1 - s1 * g2) / (s0 * s2 - s1 * s1), b + (s0 * g2 - s1 * g1) / (s0 * s2 - s1 * s1)
      from (select *, list_sum(w) as s0, list_sum(list_transform(w, lambda v, i: v * d[i])) as s1, list_sum(list_transform(w, lambda v, i: v * d[i] * d[i])) as s2,
                list_sum(list_transform(p, lambda v, i: k[i] - n[i] * v)) as g1, list_sum(list_transform(p, lambda v, i: (k[i] - n[i] * v) * d[i])) as g2
            from (select *, list_transform(p, lambda v, i: n[i] * v * (1 - v)) as w
                  from (select *, list_transform(d, lambda x: 1 / (1 + exp(-(a + b * x)))) as p from it where step < 15)))),
    f0 as (select *, list_transform(d, lambda x: 1 / (1 + exp(-(a + b * x)))) as p from it where step = 15),
    f1 as (select *, list_sum(list_transform(p, lambda v, i: n[i] * v * (1 - v))) as s0, list_sum(list_transform(p, lambda v, i: n[i] * v * (1 - v) * d[i])) as s1,
             list_sum(list_transform(p, lambda v, i: n[i] * v * (1 - v) * d[i] * d[i])) as s2 from f0),
    f as (select l_suppkey, a, b, s2 / (s0 * s2 - s1 * s1) as va, s0 / (s0 * s2 - s1 * s1) as vb, list_sum(n)::bigint as n,
            -2 * list_sum(list_transform(p, lambda v, i: k[i] * ln(v) + (n[i] - k[i]) * ln(1 - v))) as dev from f1),
    co as (select l_suppkey, 'Intercept' as term, a as coef, va as v, dev, n from f union all select l_suppkey, 'depth', b, vb, dev, n from f)
    select l_suppkey, term, round(coef, 5) as coef, round(sqrt(v), 5) as se, round(dev, 3) as deviance, n, 'converged' as status from co"""


@query("glm_by_key", _GLM_BY_KEY)
def glm_by_key(spark, sf):
    line = table(spark, sf, "lineitem").select(
        "l_suppkey",
        ((F.col("l_linenumber") - 1) % 3 + 1).alias("depth"),
        design.flag(F.col("l_quantity") + 4 * F.col("l_linenumber") > 36).alias("correct"),
    )
    cells = models.binomial_cells(line, "correct", ["l_suppkey", "depth"])
    fit = models.binomial_glm_by_key(cells, {"depth": F.col("depth")}, ["l_suppkey"])
    figures = [F.round("coef", 5).alias("coef"), F.round("se", 5).alias("se"), F.round("deviance", 3).alias("deviance")]
    return rounded(fit.select("l_suppkey", "term", *figures, "n", "status"))
