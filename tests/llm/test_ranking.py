"""Ranked search against adding up every document's score."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from glossa.llm import ranking


def plain_terms(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def plain_search(docs, items, k=10):
    counted = [(ident, Counter(plain_terms(text))) for ident, text in docs]
    counted = [(ident, c, sum(c.values())) for ident, c in counted if c]
    total, length = len(counted), sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    asked = defaultdict(Counter)
    for ident, text in set(items):
        asked[ident].update(plain_terms(text))
    out = []
    for ident, terms in asked.items():
        scores = []
        for key, c, n in counted:
            m = 25 + 75 * n * total // length
            score = 0
            for t, times in terms.items():
                if c[t]:
                    score += times * math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
            if score > 0:
                scores.append((-score, key is None, key))
        out += [(ident, i + 1, key, -s) for i, (s, _, key) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


def found(docs, items, **more):
    return sorted(map(tuple, ranking.search(docs, items, **more).collect()), key=repr)


@pytest.mark.parametrize("segment", [8192, 7])
def test_against_all_scores(spark, sf, docs, segment, monkeypatch):
    monkeypatch.setattr(ranking, "SEGMENT_DOCS", segment)
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    want = plain_search([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert found(docs.repartition(3), items) == want


def test_odd_rows(spark, nasty, empty, monkeypatch):
    rows = [(1, "one two THREE three"), (1, "one two THREE three"), (2, None), (3, ""), (4, "...!"), (5, "zzz"), (6, "汉字 naïve ÉÉ a b"), (None, "another line"), (7, "one"), (7, "same line")]
    items = spark.createDataFrame(rows, "item_id long, text string").withColumn("score", F.lit(1)).withColumn("key", F.lit("x"))
    want = plain_search([(r.doc_id, r.text) for r in nasty.collect()], [(a, b) for a, b in rows if b is not None])
    assert found(nasty, items) == want
    monkeypatch.setattr(ranking, "BLOCK_CHARS", 8)
    assert found(nasty, items) == want
    assert found(empty, items) == [] and found(nasty, items.where("false")) == []


def test_ties_and_accumulators(spark):
    """Copies that tie over the k-th place, and frequent terms that come after accumulators are no longer made."""
    random = np.random.default_rng(4)
    words = [f"w{i}" for i in range(60)]
    share = 1 / np.arange(1, 61)
    texts = [" ".join(random.choice(words, int(random.integers(1, 30)), p=share / share.sum())) for _ in range(400)]
    rows = [(int(i), t) for i, t in enumerate([*texts, *texts[:50], *["w0 w1"] * 60])]
    items = [(i, " ".join(random.choice(words, 12))) for i in range(30)] + [(99, "w0 w1 w0")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert found(docs, spark.createDataFrame(items, "item_id long, text string"), k=5) == plain_search(rows, items, 5)


def test_stops_making_accumulators():
    """After the rare term the common one may not open accumulators for the other documents."""
    hits = [np.array([1, 2], np.int32)] * 3 + [np.array([2], np.int32)] * 50
    segment = ranking.Segment(list(range(53)), [2] * 3 + [1] * 50, hits, 53, 56)
    assert [at for _, at in segment.best([(1, 4000), (2, 5)], 3, 0)] == [0, 1, 2]
    assert segment.best([(1, 4000), (2, 5)], 3, 10**12) == []
    # Ties with the third best are all kept.
    assert len(segment.best([(2, 5)], 3, 0)) >= 50
