"""What plans move: pairs, phrases and items travel once at most, and what is small is known to be so."""

import pytest

from glossa.operators import lexical, matching, silhouette
from glossa.plans import experiments, flow_queries
from glossa.sources import files
from glossa.sources.schemas import JUDGE_REPLY, SCORE_FIELDS

from .conftest import rows


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def plan(df, kind="executedPlan"):
    return getattr(df._jdf.queryExecution(), kind)().toString()


def test_control_pairs_are_not_shuffled(spark, no_broadcast):
    a = spark.createDataFrame([(i % 7, 1.0 + i % 3, 10 + i % 4) for i in range(40)] + [(None, 1.0, 10)], "id long, zipf double, len long")
    b = spark.createDataFrame([(100 + i, 1.1 + i % 3, 9 + i % 5) for i in range(30)], "id long, zipf double, len long")
    table = matching.control_candidates(a, b, "id", "zipf", "len")
    assert plan(table).count("Join") == 1
    want = [(x.id, y.id) for x in a.collect() for y in b.collect() if abs(x.zipf - y.zipf) / x.zipf <= 0.15 and abs(x.len - y.len) / x.len <= 0.2]
    assert sorted(map(str, want)) == sorted(str((r.charged_id, r.control_id)) for r in table.collect())


def test_control_pairs_do_not_pass_the_driver(spark):
    """What is exploded is larger than Spark reckons, so neither side is broadcast however small it looks, nor while it runs."""
    a = spark.createDataFrame([(i % 9, 2.0, 10) for i in range(30)] + [(None, 2.0, 10), (40, 5.0, 10), (41, None, 10), (42, 2.0, 0)], "id long, zipf double, len long")
    b = spark.createDataFrame([(100 + i % 5, 2.0 + i % 4 / 10, 8 + i % 7) for i in range(50)] + [(None, 2.1, 9), (200, 0.0, 10)], "id long, zipf double, len long")
    table = matching.control_candidates(a, b, "id", "zipf", "len")
    assert "Broadcast" not in plan(table)
    got = table.collect()
    assert "isFinalPlan=true" in plan(table) and "Broadcast" not in plan(table)
    pairs = [(x, y) for x in a.collect() for y in b.collect() if x.zipf and x.len]
    want = [(x.id, y.id) for x, y in pairs if abs(x.zipf - y.zipf) / x.zipf <= 0.15 and abs(x.len - y.len) / x.len <= 0.2]
    assert sorted(map(str, want)) == sorted(str((r.charged_id, r.control_id)) for r in got)


def test_replies_are_parsed_once(spark):
    body = '{"factual_accuracy": 1, "practical_actionability": 2, "domain_precision": 3}'
    replies = spark.createDataFrame([(1, body), (2, "no json"), (3, None), (4, '{"factual_accuracy": 1}')], "id long, reply string")
    good, bad = files.split_scores(files.parse_scores(replies, "reply", JUDGE_REPLY, SCORE_FIELDS))
    assert [r.id for r in good.collect()] == [1] and sorted(r.id for r in bad.collect()) == [2, 3, 4]
    assert plan(good, "optimizedPlan").count("from_json") == 1


def test_requests_go_to_the_line_items(spark, sf, monkeypatch):
    seen = []
    monkeypatch.setattr(experiments, "quality_analysis", seen.append)
    flow_queries._quality(spark, sf)
    left = seen[0]._jdf.queryExecution().optimizedPlan().children().head()
    while left.children().size() == 1:
        left = left.children().head()
    join = next(p for p in [seen[0]._jdf.queryExecution().optimizedPlan(), left] if p.children().size() == 2)
    assert join.children().head().stats().sizeInBytes() < 1 << 20


def test_items_are_joined_once(spark, no_broadcast):
    items = spark.createDataFrame([("bank", "n"), ("bank", "v"), ("bank", None), (None, "n"), ("oak", "n"), ("no", "n")], "word string, pos string")
    counts = spark.createDataFrame([("bank", "bank.n.02", 6), ("bank", "bank.v.01", 2), (None, "x.n.01", 9)], "lemma string, synset string, n long")
    inventory = spark.createDataFrame([("bank", "bank.n.01", 1), ("bank", "bank.v.03", 3), ("oak", "oak.v.02", 2)], "lemma string, synset string, sense_rank int")
    found = lexical.dominant_sense(items, counts, inventory, "word", "pos")
    assert plan(found, "optimizedPlan").count("LeftOuter") == 1
    assert rows(found, "word", "pos") == [
        ("bank", "n", "bank.n.02", "semcor", 6), ("bank", "v", "bank.v.03", "wordnet_ordering", 0), ("bank", None, "bank.n.01", "wordnet_ordering", 0),
        ("no", "n", "UNKNOWN", "none", 0), ("oak", "n", "oak.v.02", "wordnet_ordering", 0), (None, "n", "UNKNOWN", "none", 0),
    ]


def test_phrases_travel_without_their_text(spark, no_broadcast):
    counts = spark.createDataFrame([("a", 10), ("b", 90)], "token string, n long")
    phrases = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, "b b"), (4, "a x"), (5, "."), (6, None)], "id long, phrase string")
    found = lexical.with_phrase_zipf(phrases, counts, "phrase", "zipf")
    assert "hashpartitioning(phrase" not in plan(found)
    assert [(r.id, r.zipf) for r in found.orderBy("id").collect()] == [(1, 7.95), (2, 7.95), (3, 8.65), (4, 0.0), (5, None), (6, None)]


def test_pairs_are_counted_before_they_are_moved(spark, no_broadcast):
    corpus = spark.createDataFrame([("a b c a",), ("a",), ("",), (None,), ("b a",)], "text string")
    wanted = spark.createDataFrame([("a", "b"), ("a", "z")], "word_a string, word_b string")
    found = lexical.cooccurrence(corpus, "text", 2, wanted)
    shown = plan(found, "optimizedPlan")
    assert shown.index("LeftSemi") < shown.index("Aggregate [word_a")
    assert rows(found) == [("a", "b", 3)]
    assert rows(lexical.cooccurrence(corpus, "text", 2)) == [("a", "b", 3), ("a", "c", 2), ("b", "c", 1)]
    assert "zip_with" not in plan(lexical.cooccurrence(corpus, "text", 2), "optimizedPlan")


def test_words_are_weighed_where_the_document_lies(spark):
    docs = spark.createDataFrame([(1, "a a b", "x"), (2, "b c", "y"), (2, "c", "y"), (None, "a", None), (3, None, "x")], "doc_id long, text string, lang string")
    weights = silhouette.tfidf(docs, "doc_id", "text")
    assert plan(weights).count("Exchange hashpartitioning") == 1
    assert {(r.doc_id, r.token) for r in weights.collect()} == {(1, "a"), (1, "b"), (2, "b"), (2, "c"), (None, "a")}


def test_anchors_are_known_to_be_few(spark):
    texts = spark.createDataFrame([(1, "Oak trees, 42."), (2, "an oaken x-ray"), (3, None)], "doc_id long, text string")
    passages = spark.createDataFrame([(p, p) for p in ("oak", "42", "-", "trees", "ken x")], "name string, passage string")
    found = lexical.containing_passages(texts, passages, "doc_id", "text", "name", "passage")
    assert "FileScan parquet" in plan(found)
    assert rows(found) == [(1, "42"), (1, "oak"), (1, "trees"), (2, "-"), (2, "ken x"), (2, "oak")]
