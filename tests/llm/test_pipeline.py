"""The stages and the whole run against plain versions, on rows that are odd in every column."""

import hashlib
import unicodedata
from collections import Counter

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from glossa.llm import langid, pii
from glossa.llm.queries import vocabulary
from tests.llm.test_models import plain_components, plain_fingerprint

STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def mixed(spark, docs, nasty):
    """Documents of the table beside the odd ones, with the extra columns of those."""
    return docs.where("doc_id < 120").withColumn("doc_id", F.col("doc_id") + 1000).unionByName(nasty, allowMissingColumns=True).repartition(3).cache()


def rows(df):
    return Counter(map(repr, df.collect()))


def letters(text):
    return any(unicodedata.category(c)[0] == "L" for c in text or "")


def plain_kept(docs):
    """Rows that are the first of their group of fingerprints; equal rows once."""
    held = [(r.doc_id, r.text) for r in docs]
    group, out = {}, {}
    for ident, mark, least in plain_components(held):
        group[ident, mark] = least
    for r in docs:
        mark = f"{plain_fingerprint(r.text):016x}"
        if group[r.doc_id, mark] == r.doc_id:
            signed = int(mark, 16) - (1 << 64 if int(mark, 16) >> 63 else 0)
            best = out.get(r.doc_id)
            if best is None or signed < best[0]:
                out[r.doc_id] = signed, r
    return [r for _, r in out.values()]


def test_language_stage(spark, mixed, sf):
    found = STAGES["language_id"](spark, mixed, sf)
    assert found.columns == mixed.columns
    assert rows(found) == Counter(repr(r) for r in mixed.collect() if letters(r.text))


def test_mixed_languages_stay(spark, docs, sf):
    by = {lang: docs.where(F.col("lang") == lang).where("length(text) > 300").first().text[:300] for lang in ("en", "fr", "de", "es")}
    many = docs.union(spark.createDataFrame([(9000, " ".join(by.values()), None, None, 1)], docs.schema))
    assert STAGES["language_id"](spark, many, sf).where("doc_id = 9000").count() == 1


def test_near_duplicate_stage(spark, mixed, sf):
    some = mixed.where("doc_id is not null")
    found = STAGES["near_duplicates"](spark, some, sf)
    assert found.columns == some.columns
    assert rows(found) == Counter(map(repr, plain_kept(some.collect())))


def test_personal_data_stage(spark, mixed, sf):
    found = STAGES["personal_data"](spark, mixed, sf)
    assert found.columns == mixed.columns
    want = pii.sanitise(mixed).select("row.doc_id", "clean_text")
    assert rows(found.select("doc_id", F.col("text").alias("clean_text"))) == rows(want)
    assert found.where("n_chars != length(text)").count() == 0
    left = [r.text for r in found.collect()]
    assert not any("joe.doe+x@mail.example.com" in t or "4111 1111 1111 1111" in t for t in left)


def test_mixture_stage(spark, mixed, sf):
    """All rows, in blocks: at every block each source has its share."""
    found = STAGES["mixture"](spark, mixed, sf)
    assert found.columns == mixed.columns and rows(found) == rows(mixed)


def test_token_stage(spark, mixed, sf):
    lib = Tokenizer.from_file(vocabulary())
    want = Counter()
    for r in mixed.collect():
        ids = lib.encode(r.text or "", add_special_tokens=False).ids
        want[r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()] += 1
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256) for r in STAGES["tokens"](spark, mixed, sf).collect())
    assert got == want


def test_run(spark, mixed, sf, tmp_path):
    """The rows of the run are those of the stages' decisions, whatever order the mixture gives them."""
    mixed.where("doc_id is not null").write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    docs = [r for r in spark.read.parquet(f"{tmp_path}/documents.parquet").collect() if letters(r.text)]
    kept = plain_kept(docs)
    clean = {r.doc_id: r.clean_text for r in pii.sanitise(spark.createDataFrame(kept, mixed.schema)).select("row.doc_id", "clean_text").collect()}
    lib = Tokenizer.from_file(vocabulary())
    want = Counter()
    for ident, text in clean.items():
        ids = lib.encode(text, add_special_tokens=False).ids
        want[ident, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256) for r in got) == want


def test_empty_run(spark, mixed, tmp_path):
    mixed.where("false").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert langid.fit(spark.read.parquet(f"{tmp_path}/documents.parquet")).languages == []
