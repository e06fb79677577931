import math
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from glossa.operators import lexical as ops

from .conftest import rows

GOLDEN = (
    "item_id string, word string, depth string, dominant string, enc_synset string, dict_synset string, "
    "zipf_enc double, zipf_dict double, in_manual boolean, want_mismatch boolean, want_lower boolean, want_tier string"
)


@pytest.fixture(scope="module")
def golden(spark):
    path = Path(__file__).parent / "data" / "critical_items.csv"
    return ops.critical_tiers(spark.read.schema(GOLDEN).option("header", True).option("enforceSchema", True).csv(str(path)))


def test_golden_rows(golden):
    assert golden.count() == 50
    wrong = golden.filter("tier <> want_tier or sense_mismatch <> want_mismatch or freq_lower <> want_lower")
    assert wrong.count() == 0


def test_golden_summary(golden):
    got = {r["depth"]: tuple(r)[1:] for r in ops.tier_summary(golden, "depth").collect()}
    assert got[None] == (50, 24, 10, 0, 14)
    assert {d: v[:2] for d, v in got.items()} == {None: (50, 24), "shallow": (15, 6), "medium": (15, 7), "deep": (20, 11)}


def test_tier_rules(spark):
    df = spark.createDataFrame(
        [
            ("a.n.02", "a.n.01", "a.n.01", 1.0, 2.0, True),
            ("a.n.02", "a.n.01", "a.n.03", 2.0, 2.0, True),
            ("a.n.01", "a.n.01", "a.n.03", 1.0, 2.0, True),
            ("a.n.02", "a.n.01", "a.n.02", 1.0, 2.0, False),
            ("a.n.02", "a.n.01", "a.n.01", None, 2.0, False),
        ],
        "enc_synset string, dict_synset string, dominant string, zipf_enc double, zipf_dict double, in_manual boolean",
    )
    assert [r["tier"] for r in ops.critical_tiers(df).collect()] == ["T1_auto", "T2_auto", "T3_manual", "-", "T2_auto"]


@pytest.fixture(scope="module")
def senses(spark):
    tags = (
        [("four", "four.n.02")] * 4
        + [("five", "five.n.02")] * 3
        + [("five", "five.n.01")] * 2
        + [("tied", "tied.n.02")] * 3
        + [("tied", "tied.n.01")] * 3
        + [("verb", "verb.v.01")] * 9
    )
    tagged = spark.createDataFrame(tags, "lemma string, synset string")
    inventory = spark.createDataFrame(
        [("four", "four.n.01", 1), ("four", "four.n.02", 2), ("verb", "verb.v.01", 1), ("verb", "verb.v.07", 0), ("five", "five.n.09", 1)],
        "lemma string, synset string, sense_rank int",
    )
    return tagged, inventory


def test_dominant_sense(spark, senses):
    tagged, inventory = senses
    items = spark.createDataFrame([(w, "n") for w in ("four", "five", "tied", "verb", "none")], "word string, pos string")
    out = ops.dominant_sense(items, ops.sense_counts(tagged, expand_lemmas=False), inventory, "word", "pos")
    assert rows(out, "word") == [
        ("five", "n", "five.n.02", "semcor", 3),
        ("four", "n", "four.n.01", "wordnet_ordering", 0),
        ("none", "n", "UNKNOWN", "none", 0),
        ("tied", "n", "tied.n.01", "semcor", 3),
        ("verb", "n", "verb.v.07", "wordnet_ordering", 0),
    ]


def test_lemma_expansion(spark):
    tagged = spark.createDataFrame([("map", "function.n.01")] * 2 + [("function", "function.n.01")], "lemma string, synset string")
    inventory = spark.createDataFrame([("map", "function.n.01", 1), ("mapping", "function.n.01", 1)], "lemma string, synset string, sense_rank int")
    assert rows(ops.sense_counts(tagged, inventory)) == [("map", "function.n.01", 3), ("mapping", "function.n.01", 3)]
    assert rows(ops.sense_counts(tagged, expand_lemmas=False)) == [("function", "function.n.01", 1), ("map", "function.n.01", 2)]
    with pytest.raises(ValueError):
        ops.sense_counts(tagged)


def test_zipf(spark):
    corpus = spark.createDataFrame([("a a a b",)], "text string")
    zipf = ops.zipf_table(ops.token_counts(corpus, "text"))
    assert dict(rows(zipf)) == {"a": round(math.log10(0.75e9), 2), "b": round(math.log10(0.25e9), 2)}
    asked = spark.createDataFrame([(1, "A"), (2, "zz"), (3, ""), (4, None)], "i int, w string")
    assert [r[2] for r in rows(ops.with_zipf(asked, zipf, "w", "z"), "i")] == [8.88, 0.0, None, None]


def test_phrase_zipf(spark):
    counts = spark.createDataFrame([("lock", 1), ("in", 3), ("rest", 996)], "token string, n bigint")
    asked = spark.createDataFrame([(1, "Lock-in"), (2, "in"), (3, "lock zz"), (4, ""), (5, "Lock-in")], "i int, w string")
    got = [r["z"] for r in ops.with_phrase_zipf(asked, counts, "w", "z").orderBy("i").collect()]
    both = round(math.log10(1e9 / (1000 / 1 + 1000 / 3)), 2)
    assert got == [both, round(math.log10(3e6), 2), 0.0, None, both]


def brute_pairs(text, window):
    w = text.split()
    out = {}
    for i in range(len(w)):
        for j in range(i + 1, min(i + window, len(w) - 1) + 1):
            key = tuple(sorted((w[i], w[j])))
            out[key] = out.get(key, 0) + 1
    return out


@pytest.mark.parametrize("text", ["a b a c b", "a", "", "x y"])
def test_cooccurrence(spark, text):
    got = ops.cooccurrence(spark.createDataFrame([(text,)], "t string"), "t", 3)
    assert {(r[0], r[1]): r[2] for r in got.collect()} == brute_pairs(text, 3)


def test_passages_cut_out_of_words(spark):
    texts = spark.createDataFrame(
        [(1, "xxalpha beta gamma delta epsilon zeta eta thetayy"), (2, "alpha beta gamma"), (3, "ALPHA Beta gammas"), (4, "beta")],
        "d int, t string",
    )
    passages = spark.createDataFrame(
        [(10, "alpha beta gamma delta epsilon zeta eta theta"), (11, "Alpha beta GAMMA"), (12, "beta gamma delta")], "p int, s string"
    )
    got = ops.containing_passages(texts, passages, "d", "t", "p", "s")
    assert rows(got) == [(1, 10), (1, 11), (1, 12), (2, 11), (3, 11)]


def test_passages_with_few_words_or_none(spark):
    texts = spark.createDataFrame(
        [(1, "driver BANKS, 42 of them"), (2, "a river bank"), (3, None), (4, ""), (5, "rev-er"), (6, "x" * 50_000 + "river bank")], "d int, t string"
    )
    passages = spark.createDataFrame(
        [(10, "river bank"), (11, "ver"), (12, "42"), (13, "-"), (14, ""), (15, None), (16, "a"), (17, "a river bank"), (18, ", 4")],
        "p int, s string",
    )
    got = ops.containing_passages(texts, passages, "d", "t", "p", "s")
    want = [(1, 10), (1, 11), (1, 12), (1, 16), (1, 18), (2, 10), (2, 11), (2, 16), (2, 17), (5, 13), (6, 10), (6, 11), (6, 16)]
    assert rows(got) == want
    assert rows(ops.containing_passages(texts, passages.limit(0), "d", "t", "p", "s")) == []


def test_markers_count_documents(spark):
    texts = spark.createDataFrame([("s", "the the cat"), ("s", "the"), ("t", None), ("t", "he")], "source string, t string")
    lexicon = spark.createDataFrame([("the", "article"), ("he", "gender"), ("he", "gender")], "token string, category string")
    got = ops.marker_counts(texts, lexicon, "t", "source").select("source", "category", "n_markers", "n_documents")
    assert rows(got) == [("s", "article", 3, 2), ("t", "gender", 1, 1)]


def test_concept_documents_limit(spark):
    docs = spark.range(250).select("id", F.when(F.col("id") % 2 == 0, "Nurse here").otherwise("none").alias("t"))
    concepts = spark.createDataFrame([("C1", "nurse"), ("C2", "absent")], "concept_id string, lemma string")
    got = ops.concept_documents(docs, concepts, "id", "t", 100)
    assert [r["id"] for r in got.orderBy("id").collect()] == list(range(0, 200, 2))


def test_limit_per_group_is_applied_before_the_shuffle(spark):
    docs = spark.range(100).select("id", F.lit("nurse").alias("t"))
    concepts = spark.createDataFrame([("C1", "nurse")], "concept_id string, lemma string")
    plan = ops.concept_documents(docs, concepts, "id", "t", 5)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_band_flags_report_both_ends(spark):
    df = spark.createDataFrame([("medium", 31, 4.0), ("medium", 1, 7.0), ("high", 5, 3.5)], "b string, n int, z double")
    got = ops.band_flags(df, "b", "n", "z", ops.BAND_SYNSETS, ops.TERM_ZIPF)
    assert [tuple(r)[3:] for r in got.collect()] == [(False, True, False), (True, False, True), (False, False, False)]


def test_threshold_is_strict(spark):
    df = spark.createDataFrame([("deep", 2.8), ("deep", 2.79), ("shallow", 3.49)], "d string, z double")
    assert [r["z"] for r in ops.below_threshold(df, "d", "z", ops.DEPTH_THRESHOLDS).collect()] == [2.79, 3.49]


def test_readability_of_a_text_without_words(spark):
    df = spark.createDataFrame([("123 ...",), ("The cat sat. The end!",)], "t string")
    empty, full = [tuple(r) for r in ops.readability(df, "t").collect()]
    assert empty == (None, None)
    assert full[0] == pytest.approx(4 / 5)
    assert full[1] == pytest.approx(0.39 * 5 / 2 + 11.8 * 5 / 5 - 15.59)
