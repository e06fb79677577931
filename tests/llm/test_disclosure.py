import math
import re
from collections import defaultdict

from pyspark.sql import functions as F

from glossa.llm import pii


def test_terms_far_from_the_entity(spark):
    filler = " ".join(f"filler{i}" for i in range(200))
    rows = [(i, f"plain words number{i} about the weather {filler}") for i in range(40)]
    rows += [(100 + i, f"Zorblat wrote letter{i} {filler} the end boss@corp.example.com") for i in range(5)]
    rows += [(200 + i, f"boss@corp.example.com has {filler} the note{i}") for i in range(2)]
    rows += [(300, rows[40][1]), (301, None)]
    got = {r.row.doc_id: r for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i in (*range(100, 105), 300):
        assert "zorblat" in {x.v.lower() for x in got[i].spans if x.kind == "term"}
        assert "Zorblat" not in got[i].clean_text
        assert " filler7 " in got[i].clean_text and " the  <email>" in got[i].clean_text
    assert got[0].clean_text == rows[0][1]


def test_terms_are_those_of_all_pairs(docs):
    df = docs.select("doc_id", "text")
    df = df.union(df.where("doc_id % 7 = 0")).union(df.where("doc_id % 14 = 0"))
    texts = pii.sanitise(df).select(F.xxhash64("text").alias("mark"), "text", "base")
    held, words = defaultdict(set), {}
    for r in texts.collect():
        words[r.text] = set(re.findall(r"[^\W_]+", r.text.lower()))
        for x in r.base:
            held[x.v.lower()].add(r.text)
    rows = defaultdict(int)
    for found in words.values():
        for w in found:
            rows[w] += 1
    want, n = {}, len(words)
    for entity, where in held.items():
        for w in set().union(*(words[t] for t in where)) if pii.SUPPORT <= len(where) < n else ():
            both = sum(w in words[t] for t in where)
            share = math.log2(both * n / (len(where) * rows[w])) / math.log2(n / len(where))
            if both >= pii.SUPPORT and share >= pii.GENERALISE:
                want[entity, w] = round(share, 9)
    got = {(r.entity, r.term): round(r.disclosure, 9) for r in pii.disclosing_terms(texts.where("size(base) > 0"), texts.where("size(base) = 0").select("mark", "text"))[0].collect()}
    assert got == want
