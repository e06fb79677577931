"""No row is lost or doubled where keys are null or repeated."""

from pyspark.sql import functions as F

from glossa.operators import agreement, design, models, ranks, summaries


def test_item_ids_keep_every_row(spark):
    df = spark.createDataFrame([("s", 1), ("s", None), (None, 2), ("t", 1), ("t", 1), ("t", 3)], "stratum string, seq int")
    got = ranks.item_ids(df, F.col("stratum"), "seq", "i").collect()
    ids = sorted((r.stratum or "", r.seq or 0, r.item_id or "") for r in got)
    assert ids == [("", 2, "i_001"), ("s", 0, ""), ("s", 1, "i_002"), ("t", 1, "i_003"), ("t", 1, "i_004"), ("t", 3, "i_005")]


def test_null_slice_and_topic_stay(spark):
    df = spark.createDataFrame([(None, 1), (None, 1), ("a", None), ("a", None), ("a", 2), ("b", 3)], "k string, t int")
    got = sorted(((r.k or "", r.t) for r in summaries.drop_small_topics(df, ["k"], "t", 2).collect()), key=repr)
    assert got == sorted([("", 1), ("", 1), ("a", None), ("a", None), ("a", -1), ("b", -1)], key=repr)


def test_box_of_a_null_key(spark):
    df = spark.createDataFrame([(None, float(i)) for i in range(9)] + [("a", 1.0)], "k string, v double")
    got = {r.k: (r.median, r.n) for r in ranks.box_summary(df, ["k"], "v").collect()}
    assert got == {None: (4.0, 9), "a": (1.0, 1)}


def test_fleiss_leaves_out_ratings_of_no_item(spark):
    rows = [(1, "x"), (1, "x"), (2, "y"), (2, "x")]
    schema = "item int, c string"
    plain = agreement.fleiss_kappa(spark.createDataFrame(rows, schema), "item", "c").first()
    assert agreement.fleiss_kappa(spark.createDataFrame([*rows, (None, "x"), (None, "y")], schema), "item", "c").first() == plain


def test_preference_at_the_edges(spark):
    def of(rows):
        return models.linear_or_step(spark.createDataFrame(rows, "x int, y double"), "x", "y").first()["preferred"]

    assert of([(i, 2.0 * i) for i in range(4)]) == "linear"
    assert of([(0, 1.0), (1, 1.4), (0, 1.2), (1, 1.3)]) == "linear"
    assert of([(0, 1.0), (1, 1.0), (2, 5.0), (3, 5.0)]) == "threshold (step)"
    assert of([]) is None


def test_missing_outcomes_are_undetermined(spark):
    rows = [("a", "E2", True), ("a", "E3", False), ("b", "E4", True), ("b", "E3", True)]
    df = spark.createDataFrame(rows, "k string, experiment string, confirmed boolean")
    got = {r[0]: tuple(r)[1:] for r in summaries.adjudicate(df, ["k"]).collect()}
    assert got == {"a": ("undetermined", "undetermined", "disconfirmed"), "b": ("undetermined",) * 3}


def test_level_of_focal_cells(spark):
    rows = [(False, False, False, False), (True, False, False, False), (True, True, True, False), (True,) * 4, (False, True, False, False)]
    df = spark.createDataFrame(rows, "D boolean, R boolean, V boolean, C boolean")
    assert [r[0] for r in df.select(design.canonical_level()).collect()] == [0, 1, 2, 3, None]
