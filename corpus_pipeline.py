"""Corpus preparation in five stages: language, near copies, personal data, mixture, tokens.

Each stage reads what the one before wrote. All but the last return the columns of ``documents``; a null or empty text
is rejected by the first stage, as it has no language.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.llm import bpe, langid, mixing, pii, simhash
from glossa.llm.common import stored, table
from glossa.llm.queries import vocabulary


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are written in a language, mixed ones too. The field learns from this stage's own labelled input."""
    told = "lang_pred"
    while told in docs.columns:
        told += "_"
    found = langid.identify(docs, langid.fit(docs), lang=told, score=f"{told}score")
    return found.where(F.col(told) != "und").select(*[F.col(f"`{c}`") for c in docs.columns])


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints (four-word shingles, four bits): that with the smallest id, once."""
    return simhash.representatives(docs)


def sanitised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with personal data and the terms that disclose it replaced; ``n_chars`` follows the new text."""
    clean = pii.sanitise(docs).withColumn("text", F.col("clean_text"))
    kept = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return clean.select(*[kept.get(c, F.col(f"row.{c}")).alias(c) for c in docs.columns])


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in the order of the mixture: range-partitioned by slot and sorted, so the files follow one another."""
    found = mixing.mix(docs)
    return found.repartitionByRange("slot", "place").sortWithinPartitions("slot", "place").select("row.*")


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with the digests of ids and decoded text."""
    return bpe.digests(bpe.encode_decode(docs, vocabulary()))


STAGES = [
    ("language_id", identified),
    ("near_duplicates", deduplicated),
    ("personal_data", sanitised),
    ("mixture", mixed),
    ("tokens", encoded),
]
# Fitting, star contraction and encoding are not SQL; tests/llm/test_pipeline.py compares the rows with a brute-force pipeline.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each stage's output is a table in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
