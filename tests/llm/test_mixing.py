import random
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from glossa.llm import mixing

MANY = {"big": 0.5} | {f"small{i}": 0.0001 for i in range(5000)}
MIDDLE = {"big": 0.5} | {f"mid{i}": 0.01 for i in range(40)} | {f"small{i}": 0.0005 for i in range(200)}
ODD = {f"s{i}": random.Random(i).random() ** 4 + 0.01 for i in range(60)}


@pytest.mark.parametrize("weights, segments", [({"a": 1.0, "b": 2.0}, 2000), (MANY, 2), (MIDDLE, 12), (ODD, 20)])
def test_segments_keep_every_window_of_the_given_weights(weights, segments, monkeypatch):
    monkeypatch.setattr(mixing, "SLOTS", 1)
    monkeypatch.setattr(mixing, "SLOTS_OF_SOURCE", 1)
    parts = mixing.exact_parts(weights)
    length = mixing.segment_length(list(parts.values()))
    slots = length * segments
    names, total, share = list(parts), sum(parts.values()), sum(map(Fraction, weights.values()))
    assert all(Fraction(parts[s], total) == Fraction(w) / share for s, w in weights.items())
    had, rows = Counter(), []
    for start in range(0, slots, length):
        rows += mixing.segment(list(parts.values()), start, start + length, start + length >= slots)
    assert [r[2] for r in rows] == list(range(slots))
    for s, j, slot, release, due in rows:
        w = parts[names[s]]
        assert had[s] == j and release == j * total // w <= slot < due == -(-(j + 1) * total // w)
        had[s] += 1
        if slot % 97 == 0:
            assert all(abs(had[i] * total - p * (slot + 1)) < total for i, p in enumerate(parts.values()))
    assert sum(had.values()) == slots


def test_shares_of_given_weights(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SLOTS", 1000)
    rows = spark.range(12_000).withColumn("source", F.when(F.col("id") % 3 == 0, "a").otherwise("b"))
    got = mixing.mix(rows, {"a": 1.0, "b": 2.0}, key="id", block=1).select("row.source", "slot", "block").collect()
    assert sorted(r.slot for r in got) == list(range(12_000))
    had = 0
    for r in sorted(got, key=lambda r: r.slot):
        had += r.source == "a"
        assert abs(3 * had - (r.slot + 1)) < 3
