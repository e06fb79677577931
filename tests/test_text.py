import math

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from glossa.functions import tails
from glossa.functions import text as tx

from .conftest import rows


def one(spark, value, expression, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expression.alias("x")).first()["x"]


@pytest.mark.parametrize("value", ["  a b ", "\t x \n", "　", "", "a", "\x1c z \x85"])
def test_strip_is_pythons(spark, value):
    assert one(spark, value, tx.strip("v")) == value.strip()
    assert one(spark, value, tx.non_blank("v")) == bool(value.strip())


def test_render_fills_named_placeholders_once(spark):
    df = spark.createDataFrame([("{b}", "y")], "a string, b string")
    template = 'Rate {a} by {b}: {"score": <int>}'
    assert df.select(tx.render(template, a="a", b="b")).first()[0] == 'Rate {b} by y: {"score": <int>}'


def test_hashes(spark):
    prompt, model = "Décris « banc »", "org/chat-70b"
    assert one(spark, prompt, tx.prompt_hash("v")) == hashlib.md5(prompt.encode()).hexdigest()[:8]
    digest = hashlib.md5(f"{prompt}{model}{0.7}{3}".encode()).hexdigest()[:8]
    assert one(spark, prompt, tx.call_id("v", F.lit(model), F.lit(0.7), F.lit(3))) == f"chat-70b_{digest}_3"


def test_tags(spark):
    assert one(spark, 0.8, tx.slice_tag(F.lit("gpt4o"), "v"), "double") == "gpt4o_T08"
    assert one(spark, 0.0, tx.two_way_tag("v"), "double") == "T0"
    assert one(spark, 0.7, tx.two_way_tag("v"), "double") == "T07"


@pytest.mark.parametrize("synset,pos", [("bank.n.01", "n"), ("St._Louis.v.02", "v"), ("UNKNOWN", "n"), ("a.b", "a")])
def test_part_of_speech(spark, synset, pos):
    assert one(spark, synset, tx.part_of_speech("v")) == pos


def test_reading_label(spark):
    df = spark.createDataFrame(
        [("The RIVER bank", "river Bank"), ("a bank", "river"), (None, "x"), ("x", None), ("x", "")], "r string, g string"
    )
    got = [r[0] for r in df.select(tx.reading_label("r", "g")).collect()]
    assert got == ["encyclopedic", "neither", None, None, "encyclopedic"]


def test_words(spark):
    assert one(spark, "Über-Maß, l’été 3x!", tx.words("v")) == ["über", "maß", "l", "été", "x"]


@pytest.mark.parametrize(
    "t,dof,p", [(2.228138851964939, 10, 0.05), (12.706204736432095, 1, 0.05), (0.0, 5, 1.0), (1.959963984540054, 1e9, 0.05)]
)
def test_t_tail(t, dof, p):
    assert tails.t_two_sided(t, dof) == pytest.approx(p, rel=1e-7)
    assert tails.t_two_sided(-t, dof) == pytest.approx(p, rel=1e-7)


def test_normal_tail():
    assert tails.normal_two_sided(1.959963984540054) == pytest.approx(0.05, rel=1e-12)


def test_rows_helper_sorts_nulls_last(spark):
    assert rows(spark.createDataFrame([(None,), (1,)], "v int")) == [(1,), (None,)]


def test_t_tail_has_one_form_for_all_degrees_of_freedom():
    assert float(tails.t_two_sided(3.0, 1)) == pytest.approx(1 - 2 / math.pi * math.atan(3.0), rel=1e-13)
    assert float(tails.t_two_sided(3.0, 2)) == pytest.approx(1 - 3 / math.sqrt(11), rel=1e-13)
    assert float(tails.t_two_sided(1.5, 1e12)) == pytest.approx(tails.normal_two_sided(1.5), rel=1e-11)
    around = tails.t_two_sided(0.01, np.array([990_000, 1_000_000, 1_000_001, 2_000_000]))
    assert list(around) == sorted(around, reverse=True) and np.ptp(around) < 1e-8
    assert np.isnan(tails.t_two_sided(np.array([math.nan, 1.0]), np.array([3.0, 0.0]))).all()
