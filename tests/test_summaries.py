import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from glossa.operators import agreement, design, matching, ranks
from glossa.operators import summaries as ops

from .conftest import rows


def test_row_mean_skips_nulls(spark):
    df = spark.createDataFrame([(5, 4, None), (None, None, None), (1, 2, 3)], "a int, b int, c int")
    assert [r[0] for r in df.select(design.row_mean("a", "b", "c")).collect()] == [4.5, None, 2.0]


def test_entropy_conventions(spark):
    df = spark.createDataFrame([("a", 0)] * 2 + [("a", 1)] * 2 + [("a", -1)] * 4 + [("b", -1)] * 3 + [("c", 7)] * 5, "k string, t int")
    got = dict(rows(ops.topic_entropy(df, ["k"], "t")))
    assert got == {"a": pytest.approx(2 * 0.25 * 2), "b": 0.0, "c": pytest.approx(0.0)}
    again = dict(rows(ops.topic_entropy(df, ["k"], "t", renormalize=True)))
    assert again == {"a": pytest.approx(1.0), "b": 0.0, "c": pytest.approx(0.0)}


def test_presets_merge_small_topics(spark):
    df = spark.createDataFrame([("a", t) for t, n in ((0, 15), (1, 10), (2, 5), (3, 4)) for _ in range(n)], "k string, t int")
    got = {(r["config"], r["t"]): r["n"] for r in ops.topic_counts(df, ["k"], "t").collect()}
    assert got == {
        ("conservative", 0): 15, ("conservative", -1): 19,
        ("default", 0): 15, ("default", 1): 10, ("default", -1): 9,
        ("fine_grained", 0): 15, ("fine_grained", 1): 10, ("fine_grained", 2): 5, ("fine_grained", -1): 4,
    }
    assert ops.drop_small_topics(df, ["k"], "t", 10).filter("t = -1").count() == 9


def test_effort_of_a_constant_column_is_zero(spark):
    df = spark.createDataFrame([(1.0, 5, 2, 4.0), (3.0, 5, 4, 2.0)], "t double, e int, d int, q double")
    got = ops.effort_to_quality(df, ["t", "e", "d"], "q").orderBy("t").collect()
    assert [r["effort"] for r in got] == pytest.approx([0.0, 2.0], abs=1e-6)
    assert [r["e_norm"] for r in got] == [0.0, 0.0]


def test_min_group_boundary(spark):
    df = spark.createDataFrame([("nine",)] * 9 + [("ten",)] * 10, "k string")
    assert rows(ops.large_groups(df, ["k"])) == [("ten", 10)]


def test_sem_of_one_row_is_null(spark):
    got = rows(ops.mean_and_sem(spark.createDataFrame([("a", 1.0), ("b", 1.0), ("b", 3.0)], "k string, v double"), ["k"], "v"))
    assert got == [("a", 1.0, None, 1), ("b", 2.0, pytest.approx(1.0), 2)]


def test_judges_never_judge_themselves(spark):
    df = spark.createDataFrame([("gpt4o",), ("llama",), ("other",)], "model string")
    got = design.route_judges(df, {"gpt4o": "mistral", "llama": "gpt4o"})
    assert rows(got) == [("gpt4o", "mistral"), ("llama", "gpt4o")]
    assert got.filter("model = judge_model").count() == 0
    assert rows(design.route_judges(df, {"gpt4o": ["sonnet", "mistral"]})) == [("gpt4o", "mistral"), ("gpt4o", "sonnet")]
    with pytest.raises(ValueError, match="llama"):
        design.route_judges(df, {"llama": "llama"})


def test_required_columns(spark):
    with pytest.raises(ValueError, match="b, c"):
        design.require_columns(spark.createDataFrame([(1,)], "a int"), ["a", "b", "c"])


def test_baseline_union_keeps_temperatures(spark):
    models = spark.createDataFrame([("m", 0.7, "yes it is", "IT")], "model string, temperature double, response string, ground_truth string")
    base = spark.createDataFrame([("gpt2-xl", 0.0, "no", "it")], models.schema)
    got = ops.scored_responses(ops.with_baseline(models, base)).select("system", "temperature", "correct")
    assert rows(got) == [("gpt2_xl", 0.0, 0), ("m", 0.7, 1)]


def test_log_totals_without_usage(spark):
    df = spark.createDataFrame([("a", (5, 7)), ("a", None), ("b", None)], "model string, usage struct<prompt_tokens:bigint,completion_tokens:bigint>")
    assert rows(ops.log_totals(df, ["model"])) == [("a", 2, 5, 7), ("b", 1, 0, 0)]


def test_adjudication(spark):
    cases = {"full": "E1 E2 E3 E3U E4 E5", "part": "E4 E2 E3", "odd": "E1 E5", "none": ""}
    data = [(k, e, e in v.split()) for k, v in cases.items() for e in ("E1", "E2", "E3", "E3U", "E4", "E5")]
    got = {r[0]: tuple(r)[1:] for r in ops.adjudicate(spark.createDataFrame(data, "k string, experiment string, confirmed boolean"), ["k"]).collect()}
    assert got == {
        "full": ("confirmed", "confirmed", "inequality"),
        "part": ("restricted", "synchronic only", "quality differential"),
        "odd": ("disconfirmed", "diachronic only", "disconfirmed"),
        "none": ("fully disconfirmed", "disconfirmed", "disconfirmed"),
    }


def test_fleiss_on_a_published_table(spark):
    # Fleiss (1971): 10 items, 14 raters, 5 categories; κ = 0.210.
    table = [
        [0, 0, 0, 0, 14], [0, 2, 6, 4, 2], [0, 0, 3, 5, 6], [0, 3, 9, 2, 0], [2, 2, 8, 1, 1],
        [7, 7, 0, 0, 0], [3, 2, 6, 3, 0], [2, 5, 3, 2, 2], [6, 5, 2, 1, 0], [0, 2, 2, 3, 7],
    ]
    data = [(i, c) for i, row in enumerate(table) for c, n in enumerate(row) for _ in range(n)]
    got = agreement.fleiss_kappa(spark.createDataFrame(data, "i int, c int"), "i", "c").first()
    assert got["kappa"] == pytest.approx(0.2099, abs=1e-4)


def test_icc_on_a_published_table(spark):
    # Shrout & Fleiss (1979): ICC(2,1) = 0.29.
    table = [(9, 2, 5, 8), (6, 1, 3, 2), (8, 4, 6, 8), (7, 1, 2, 6), (10, 5, 6, 9), (6, 2, 4, 7)]
    got = agreement.icc21(spark.createDataFrame(table, "a int, b int, c int, d int"), list("abcd")).first()
    assert got["icc"] == pytest.approx(0.2898, abs=1e-4)


def test_cohen(spark):
    data = [("y", "y")] * 20 + [("y", "n")] * 5 + [("n", "y")] * 10 + [("n", "n")] * 15 + [(None, "y")]
    got = agreement.cohen_kappa(spark.createDataFrame(data, "a string, b string"), "a", "b").first()
    assert (got["n"], got["kappa"]) == (50, pytest.approx(0.4))
    same = agreement.cohen_kappa(spark.createDataFrame([("y", "y")] * 3, "a string, b string"), "a", "b").first()
    assert same["kappa"] is None


def test_mcnemar_without_discordant_rows(spark):
    got = agreement.mcnemar(spark.createDataFrame([(1, 1), (0, 0)], "a int, b int"), "a", "b").first()
    assert got["chi2"] is None


def exact_quantile(values, p):
    values = sorted(values)
    place = (len(values) - 1) * p
    low = math.floor(place)
    return values[low] + (place - low) * (values[math.ceil(place)] - values[low])


@pytest.mark.parametrize("partitions", [1, 7, 64])
def test_quantiles_with_a_hot_value(spark, partitions):
    # A third of the rows share one value, and one key holds most rows.
    values = [5.0] * 400 + [float((i * 37) % 1000) / 10 for i in range(800)]
    data = [("hot", v) for v in values] + [("cold", 1.0), ("cold", 2.0)]
    df = spark.createDataFrame(data, "k string, v double").repartition(partitions)
    got = {r["k"]: r for r in ranks.quantiles(df, ["k"], "v", {"q1": 0.25, "q2": 0.5, "q9": 0.9}).collect()}
    for name, p in (("q1", 0.25), ("q2", 0.5), ("q9", 0.9)):
        assert got["hot"][name] == pytest.approx(exact_quantile(values, p))
        assert got["cold"][name] == pytest.approx(exact_quantile([1.0, 2.0], p))


def test_average_ranks_without_key(spark):
    values = [3, 1, 3, 3, 2, 9, 9, None]
    got = dict((r["v"], r["rank"]) for r in ranks.average_ranks(spark.createDataFrame([(v,) for v in values], "v int"), "v").collect())
    assert got == {1: 1.0, 2: 2.0, 3: 4.0, 9: 6.5}


def test_item_ids_beyond_the_digits(spark):
    df = spark.range(1200).select("id", (F.col("id") % 2).alias("s"))
    got = {r["id"]: r["item_id"] for r in ranks.item_ids(df, F.col("s"), "id", "E4").collect()}
    assert (got[0], got[2], got[1], got[1199]) == ("E4_001", "E4_002", "E4_601", "E4_1200")
    assert len(set(got.values())) == 1200


def test_box_summary_without_key(spark):
    values = [1.0, 2.0, 3.0, 4.0, 5.0, 100.0, -50.0]
    got = ranks.box_summary(spark.createDataFrame([(v,) for v in values], "v double"), [], "v").first()
    assert (got["median"], got["whisker_low"], got["whisker_high"], got["n_outliers"], got["n"]) == (3.0, 1.0, 5.0, 2, 7)


def test_control_search_at_the_tolerances(spark):
    charged = spark.createDataFrame([(1, 4.0, 100), (2, 9.0, 100), (3, 0.0, 100)], "id int, zipf double, len int")
    controls = spark.createDataFrame(
        [(10, 4.6, 100), (11, 3.4, 120), (12, 4.61, 100), (13, 4.0, 121), (14, 4.1, 80), (15, 4.1, 80), (16, 0.0, 100)], charged.schema
    )
    got = matching.control_search(charged, controls, "id", "zipf", "len")
    fits = sum(abs(4.0 - r["zipf"]) / 4.0 <= 0.15 and abs(100 - r["len"]) / 100 <= 0.20 for r in controls.collect())
    assert fits == 3
    assert [tuple(r) for r in got.orderBy("id").collect()] == [(1, 4.0, 100, fits, 14), (2, 9.0, 100, 0, None), (3, 0.0, 100, 0, None)]


def test_doubled_input_leaves_shares_unchanged(spark):
    df = spark.createDataFrame([("a", i % 3, float(i)) for i in range(30)], "k string, t int, v double")
    twice = df.unionByName(df)
    once, doubled = (ops.topic_entropy(d, ["k"], "t").first()["entropy"] for d in (df, twice))
    assert once == pytest.approx(doubled)
    assert ops.accuracy(df, ["k"], "v").first()["accuracy"] == ops.accuracy(twice, ["k"], "v").first()["accuracy"]


def test_empty_input(spark):
    empty = spark.createDataFrame([], "k string, t int, v double")
    assert ops.topic_entropy(empty, ["k"], "t").count() == 0
    assert ranks.quantiles(empty, ["k"], "v", {"q": 0.5}).count() == 0
    assert ranks.average_ranks(empty, "v").count() == 0
    assert ops.effort_to_quality(empty, ["v", "t"], "v").count() == 0


def test_cumulative_over_a_scanned_column(spark, sf):
    # A scalar subquery beside a captured column once sent the bucket to the wrong side of the join.
    line = spark.read.parquet(f"{sf}/lineitem.parquet")
    ranked = ranks.cumulative(ranks.value_counts(line, [], "l_extendedprice"), [], "l_extendedprice", 64)
    got = ranked.orderBy("l_extendedprice").collect()
    assert got[0]["before"] == 0
    assert all(b["before"] == a["before"] + a["n"] for a, b in zip(got, got[1:]))
    assert got[-1]["before"] + got[-1]["n"] == got[-1]["total"] == line.count()


def test_cells_add_up_to_the_rows(spark):
    df = spark.createDataFrame([("a", 1), ("a", 9), (None, 1), ("z", None)], "f string, g int")
    got = ops.cell_counts(df, {"f": ["a", "b"], "g": [1, 2]}, minimum=1)
    cells = {(r["f"], r["g"]): (r["n"], r["too_small"]) for r in got.collect()}
    empty = {("a", 2): (0, True), ("b", 1): (0, True), ("b", 2): (0, True)}
    assert cells == {**empty, ("a", 1): (1, False), ("a", None): (1, False), (None, 1): (1, False), (None, None): (1, False)}


def test_another_rule_scores_responses(spark):
    df = spark.createDataFrame([("river", "bank"), ("bank", "bank"), (None, "bank")], "response string, ground_truth string")
    rule = F.when(F.col("response") == F.reverse("ground_truth"), "encyclopedic").when(F.col("response").isNotNull(), "neither")
    assert [r["correct"] for r in ops.scored_responses(df, rule=rule).collect()] == [0, 0, None]
    assert [r["correct"] for r in ops.scored_responses(df).collect()] == [0, 1, None]


def plain_fits(charged, controls):
    out = []
    for i, f, n in charged:
        for j, g, m in controls:
            if None not in (f, n, g, m) and min(f, n, g, m) > 0 and abs(f - g) / f <= 0.15 and abs(n - m) / n <= 0.20:
                out.append((i, j))
    return out


@pytest.mark.parametrize("places", [4096, 3])
def test_all_controls_within_the_tolerances(spark, places, monkeypatch):
    """Continuous values, values on the bounds, copies, nulls and zeros; counts and the explicit table against all pairs."""
    monkeypatch.setattr(matching, "PLACES", places)
    random = np.random.default_rng(8)
    make = lambda start, n: [(start + i, float(random.uniform(1, 3)), int(random.integers(5, 60))) for i in range(n)]
    grid = lambda start: [(start + i, round(0.05 * (i % 40 + 1), 2), i % 30 + 1) for i in range(120)]
    odd = [(1, None, 3), (2, 0.0, 3), (3, 2.0, None), (4, -1.0, 5), (5, 2.0, 0)]
    charged = make(100, 60) + grid(300) + odd
    controls = make(1000, 90) + grid(2000) + [(3000, 1.0, 10)] * 4 + odd
    names = "id long, zipf double, len long"
    a, b = spark.createDataFrame(charged, names).repartition(3), spark.createDataFrame(controls, names).repartition(3)
    want = plain_fits(charged, controls)
    table = matching.control_candidates(a, b, "id", "zipf", "len")
    assert sorted((r.charged_id, r.control_id) for r in table.collect()) == sorted(want)
    counts = {r.id: r.n_controls for r in matching.control_counts(a, b, "zipf", "len").collect()}
    assert counts == {i: sum(x == i for x, _ in want) for i, _, _ in charged}
    none = b.where("false")
    assert {r.n_controls for r in matching.control_counts(a, none, "zipf", "len").collect()} == {0}
    assert matching.control_counts(none, b, "zipf", "len").count() == matching.control_candidates(a, none, "id", "zipf", "len").count() == 0


def window_partitions(df):
    """Whether every window of the executed plan has a partition: its definition begins with one, not with an order."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return "windowspecdefinition(" in plan and not re.search(r"windowspecdefinition\([^,]*? (ASC|DESC)", plan)


def test_running_totals(spark, monkeypatch):
    monkeypatch.setattr(ranks, "CUTS", 8)
    for kind in ("long", "string"):
        rows = [(None, 7), *((i if kind == "long" else f"{i:x}\u00e9", i % 5) for i in range(300))]
        df = spark.createDataFrame(rows, f"v {kind}, n long").repartition(5)
        got = {r.v: r.before for r in ranks.running_totals(df, "v").collect()}
        order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0 if kind == "long" else (r[0] or "").encode()))
        total, want = 0, {}
        for v, n in order:
            want[v], total = total, total + n
        assert got == want
    assert ranks.running_totals(df.where("false"), "v").count() == 0


def test_many_strata(spark):
    """A hundred thousand strata of two rows: numbers without gaps, and no window over all strata."""
    df = spark.range(200_000).select(F.format_string("s%06d", F.col("id") % 100_000).alias("s"), "id")
    got = ranks.item_ids(df, F.col("s"), "id", "E4", 6)
    assert window_partitions(got)
    number = F.substring("item_id", 4, 9).cast("long")
    row = got.agg(F.count_distinct(number).alias("n"), F.min(number).alias("low"), F.max(number).alias("high")).first()
    assert tuple(row) == (200_000, 1, 200_000)
    assert got.where((number - 1) != (F.col("id") % 100_000) * 2 + F.floor(F.col("id") / 100_000)).count() == 0
