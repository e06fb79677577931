"""Conformity queries on the test tables; an embedding's label stands for its concept."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import words
from ..functions.vectors import l2_normalize, norm
from ..operators import conformity as ops
from .registry import query, rounded, table, texts

_CENTROIDS = """
    long as (select vec_id, label, unnest(embedding)::double as v, generate_subscripts(embedding, 1) as pos from embeddings),
    proto as (select label, list(m order by pos) as prototype, max(n) as n
              from (select label, pos, avg(v) as m, count(*) as n from long group by label, pos) group by label)
"""
_SCORES = f"""{_CENTROIDS},
    scored as (select e.vec_id, e.label, list_cosine_similarity(e.embedding::double[], p.prototype) as conformity
               from embeddings e join proto p using (label))
"""


def scored_vectors(spark, sf):
    vectors = table(spark, sf, "embeddings")
    return ops.conformity(vectors, ops.centroids(vectors, ["label"], "embedding", "prototype"), "label")


@query(
    "prototypes",
    f"""with {_CENTROIDS} select label, n, len(prototype) as dim, round(list_sum(prototype), 6) as total,
        round(prototype[1], 6) as first, round(prototype[-1], 6) as last from proto""",
)
def prototypes(spark, sf):
    protos = ops.centroids(table(spark, sf, "embeddings"), ["label"], "embedding", "prototype")
    return rounded(
        protos.select(
            "label",
            "n",
            F.size("prototype").cast("bigint").alias("dim"),
            F.aggregate("prototype", F.lit(0.0), lambda a, v: a + v).alias("total"),
            F.element_at("prototype", 1).alias("first"),
            F.element_at("prototype", -1).alias("last"),
        )
    )


@query("conformity", f"with {_SCORES} select vec_id, label, round(conformity, 6) as conformity from scored")
def conformity(spark, sf):
    return rounded(scored_vectors(spark, sf).select("vec_id", "label", "conformity"))


@query(
    "concept_rank",
    f"""with {_SCORES} select label, round(avg(conformity), 6) as conformity, count(*) as n
        from scored group by label order by 2 desc, 1""",
)
def concept_rank(spark, sf):
    return rounded(ops.concept_ranking(scored_vectors(spark, sf), ["label"], "conformity"))


@query(
    "amplification",
    f"""with {_SCORES},
        o as (select s.*, d.lang = 'en' as is_model from scored s join documents d on d.doc_id = s.vec_id),
        g as (select label,
                avg(conformity) filter (is_model) as m, count(*) filter (is_model) as nm,
                avg(conformity) filter (not is_model) as c, count(*) filter (not is_model) as nc
              from o group by label)
        select label, round(m, 6) as model_mean, nm as n_model, round(c, 6) as corpus_mean, nc as n_corpus,
               round(m - c, 6) as difference, m > c as amplified from g where nm > 0 and nc > 0""",
)
def amplification(spark, sf):
    # English documents stand for model output, the others for corpus text.
    lang = table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), "lang")
    scores = scored_vectors(spark, sf).select("vec_id", "label", "conformity").join(lang, "vec_id")
    return rounded(ops.amplification(scores.filter("lang = 'en'"), scores.filter("lang <> 'en'"), "label"))


@query(
    "l2norm",
    """select vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))), 6) as length,
          round(embedding[1]::double / sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))), 6) as first
       from embeddings""",
)
def l2norm(spark, sf):
    df = table(spark, sf, "embeddings")
    return rounded(df.select("vec_id", norm("embedding").alias("length"), l2_normalize("embedding")[0].alias("first")))


@query(
    "attach_embeddings",
    """select d.doc_id, d.lang, d.source, e.label, len(e.embedding) as dim
       from documents d join embeddings e on d.doc_id = e.vec_id""",
)
def attach_embeddings(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source")
    vectors = table(spark, sf, "embeddings").withColumnRenamed("vec_id", "doc_id")
    joined = ops.attach_embeddings(docs, vectors, "doc_id")
    return joined.select("doc_id", "lang", "source", "label", F.size("embedding").cast("bigint").alias("dim"))


@query(
    "embedding_mismatch",
    """select count(*) filter (d.doc_id is null) as embeddings_without_response,
          count(*) filter (e.vec_id is null) as responses_without_embedding,
          count(*) filter (d.doc_id is not null and e.vec_id is not null) as matched
       from documents d full outer join embeddings e on d.doc_id = e.vec_id""",
)
def embedding_mismatch(spark, sf):
    vectors = table(spark, sf, "embeddings").withColumnRenamed("vec_id", "doc_id")
    return ops.embedding_mismatch(table(spark, sf, "documents"), vectors, "doc_id")


@query(
    "top_features",
    r"""with t as (select source, unnest(regexp_extract_all(lower(text), '[\p{L}\p{M}]+')) as feature from documents),
        c as (select source, feature, count(*) as n from t group by 1, 2),
        r as (select *, row_number() over (partition by source order by n desc, feature) as rank from c)
        select source, feature, n, rank::int as rank from r where rank <= 10""",
)
def top_features(spark, sf):
    mentions = texts(spark, sf).select("source", F.explode(words("text")).alias("feature"))
    return ops.top_features(mentions, ["source"], "feature", 10)


@query(
    "mean_of_means",
    """with u as (select o_custkey, year(o_orderdate)::int as generation, o_orderpriority as kind, avg(o_totalprice) as m
                  from orders group by all)
       select generation, kind, round(avg(m), 4) as mean, count(*) as n_units from u group by 1, 2""",
)
def mean_of_means(spark, sf):
    df = table(spark, sf, "orders").select(
        "o_custkey", F.year("o_orderdate").alias("generation"), F.col("o_orderpriority").alias("kind"), "o_totalprice"
    )
    return rounded(ops.trajectory(df, "o_custkey", "generation", ["kind"], "o_totalprice"), 4)
