"""Silhouette, projection, topic and TF-IDF queries on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.vectors import l2_normalize
from ..operators import clusters, conformity
from ..operators import silhouette as ops
from .registry import query, rounded, table, texts

_WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{M}]+')"
_DOCS = """base as (select e.vec_id, e.embedding::double[] as v, e.label, d.lang, d.source,
    substr(d.source, 4)::int % 5 as ctx from embeddings e join documents d on d.doc_id = e.vec_id)"""


def _sql(name: str, label: str, source: str, cosine: bool = False, minimum: int = 10) -> str:
    """CTEs that score ``source`` (id, g, label, v) by all cluster distances."""
    unit = "list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y))))" if cosine else "v"
    return f"""{name}_r as (select vec_id, g, {label} as l, {unit} as v from {source}),
    {name}_q as (select *, list_sum(list_transform(v, lambda x: x * x)) as sq from {name}_r),
    {name}_x as (select g, l, unnest(v) as x, generate_subscripts(v, 1) as pos from {name}_q),
    {name}_c as (select g, l, list(m order by pos) as mu, max(n) as n from (select g, l, pos, avg(x) as m, count(*) as n from {name}_x group by all) group by all),
    {name}_m as (select c.*, msq from {name}_c c join (select g, l, avg(sq) as msq from {name}_q group by all) using (g, l)),
    {name}_d as (select q.vec_id, q.g, q.l, m.l as c, m.n, greatest(q.sq - 2 * list_dot_product(q.v, m.mu) + m.msq, 0) as d from {name}_q q join {name}_m m using (g)),
    {name}_b as (select vec_id, g, l, min(d) filter (c <> l) as b, any_value(d * n / nullif(n - 1, 0)) filter (c = l) as a, any_value(n) filter (c = l) as n from {name}_d group by all),
    {name}_s as (select vec_id, g, l, case when b is null then null when n = 1 then 0 when greatest(a, b) > 0 then (b - a) / greatest(a, b) else 0 end as s from {name}_b),
    {name} as (select g, case when count(*) >= {minimum} then avg(s) end as sil, count(*) as n from {name}_s group by g)"""


def _points(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), "lang", "source")
    ctx = (F.substring("source", 4, 9).cast("int") % 5).alias("ctx")
    return table(spark, sf, "embeddings").join(docs, "vec_id").select("vec_id", "embedding", "label", "lang", ctx)


@query(
    "silhouette_moments",
    f"with {_DOCS}, i as (select *, lang as g from base), {_sql('t', 'label', 'i')} select g as lang, round(sil, 6) as silhouette, n from t",
)
def silhouette_moments(spark, sf):
    return rounded(ops.silhouette(_points(spark, sf), ["lang"], "label", "embedding"))


@query(
    "silhouette_samples",
    f"with i as (select vec_id, label, embedding::double[] as v, 0 as g from embeddings), {_sql('t', 'label', 'i')} select vec_id, l as label, round(s, 6) as silhouette from t_s",
)
def silhouette_samples(spark, sf):
    return rounded(ops.silhouette_samples(table(spark, sf, "embeddings"), [], "label", "embedding", keep=["vec_id"]))


@query(
    "silhouette_long",
    f"with {_DOCS}, i as (select *, lang as g from base), {_sql('t', 'label', 'i', True)} select vec_id, g as lang, l as label, round(s, 6) as silhouette from t_s",
)
def silhouette_long(spark, sf):
    return rounded(ops.silhouette_samples(_points(spark, sf), ["lang"], "label", "embedding", cosine=True, keep=["vec_id"]))


@query(
    "silhouette_many_clusters",
    f"""with {_DOCS}, k as (select vec_id, v, case when vec_id % 7 <> 0 then lang end as lang,
                label || '/' || source || '/' || vec_id % 40 as label from base),
        i as (select *, coalesce(lang, '-') as g from k), {_sql('t', 'label', 'i')}
        select vec_id, nullif(g, '-') as lang, l as label, round(s, 6) as silhouette from t_s""",
)
def silhouette_many_clusters(spark, sf):
    # Hundreds of clusters to a group; every seventh point has no language and stays a group of its own.
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), "lang", "source")
    points = table(spark, sf, "embeddings").join(docs, "vec_id")
    label = F.concat_ws("/", "label", "source", F.col("vec_id") % 40)
    lang = F.when(F.col("vec_id") % 7 != 0, F.col("lang"))
    points = points.select("vec_id", "embedding", label.alias("label"), lang.alias("lang"))
    return rounded(ops.silhouette_samples(points, ["lang"], "label", "embedding", keep=["vec_id"]))


_DELTA = f"""{_DOCS}, i as (select *, lang as g from base), p as (select * from i where ctx >= 3),
    {_sql('lem', 'label', 'i', True)}, {_sql('ctx', 'ctx', 'i', True)}, {_sql('par', 'ctx', 'p', True)},
    delta as (select g as lang, lem.sil as sil_lemma, lem.n, ctx.sil as sil_ctx, par.sil as sil_ctx_paraphrase, ctx.sil - lem.sil as delta_ctx_lemma
              from lem join ctx using (g) left join par using (g) where lem.n >= 10)"""


def _delta(spark, sf):
    # The five source classes stand for the five prompt variants, the last two for paraphrases.
    return ops.context_against_lemma(_points(spark, sf), ["lang"], "label", "ctx", "embedding", F.col("ctx") >= 3, cosine=True)


@query(
    "silhouette_delta",
    f"""with {_DELTA} select lang, round(sil_lemma, 6) as sil_lemma, n, round(sil_ctx, 6) as sil_ctx, round(sil_ctx_paraphrase, 6) as sil_ctx_paraphrase,
        round(delta_ctx_lemma, 6) as delta_ctx_lemma from delta""",
)
def silhouette_delta(spark, sf):
    return rounded(_delta(spark, sf))


@query(
    "delta_by_stratum",
    f"""with {_DELTA}, {_sql('lem2', 'label', 'i')}, {_sql('ctx2', 'ctx', 'i')},
        u as (select lang, delta_ctx_lemma as d from delta union all select g, ctx2.sil - lem2.sil from lem2 join ctx2 using (g) where lem2.n >= 10)
        select lang, round(avg(d), 6) as mean_delta, count(*) as n_combinations from u group by 1""",
)
def delta_by_stratum(spark, sf):
    # Cosine and squared Euclidean results stand for two embedders.
    plain = ops.context_against_lemma(_points(spark, sf), ["lang"], "label", "ctx", "embedding", F.col("ctx") >= 3)
    return rounded(ops.delta_by_stratum(ops.union_embedders({"a": _delta(spark, sf), "b": plain}), "lang"))


@query(
    "delta_by_family",
    f"""with {_DOCS}, i as (select *, case when ctx >= 3 then 'paraphrase' else 'explicit' end as g from base),
        {_sql('lem', 'label', 'i', True)}, {_sql('ctx', 'ctx', 'i', True)}
        select g as family, round(lem.sil, 6) as sil_lemma, round(ctx.sil, 6) as sil_ctx, round(ctx.sil - lem.sil, 6) as delta_ctx_lemma from lem join ctx using (g)""",
)
def delta_by_family(spark, sf):
    families = _points(spark, sf).withColumn("family", F.when(F.col("ctx") >= 3, "paraphrase").otherwise("explicit"))
    result = ops.context_against_lemma(families, ["family"], "label", "ctx", "embedding", F.lit(True), cosine=True)
    return rounded(result.select("family", "sil_lemma", "sil_ctx", "delta_ctx_lemma"))


_DIM = 64
_PLANES = ", ".join(
    "[" + ", ".join(str(ops.sign_vector(seed, c, _DIM)) for c in range(2)) + "]" for seed in range(ops.SEEDS)
)


@query(
    "sil_stability",
    f"""with {_DOCS}, planes as (select unnest(range({ops.SEEDS})) as seed, unnest([{_PLANES}]::double[][][]) as m),
        i as (select vec_id, label, lang || '/' || seed as g, [list_dot_product(v, m[1]), list_dot_product(v, m[2])] as v from base, planes),
        {_sql('t', 'label', 'i')}
        select split_part(g, '/', 1) as lang, round(avg(sil), 6) as mean, round(stddev_pop(sil), 6) as std, stddev_pop(sil) > 0.05 as unstable, max(n) as n from t group by 1""",
)
def sil_stability(spark, sf):
    return rounded(ops.silhouette_stability(_points(spark, sf), ["lang"], "label", "embedding", _DIM))


def _leading(n: int, matrix: str) -> str:
    """CTEs of the leading eigenvector ``v`` and value of a covariance matrix, by squaring it: no power iteration to converge."""
    product = "list_transform(m, lambda r: list_transform(m, lambda s: list_dot_product(r, s)))"
    trace = "list_sum(list_transform(m, lambda r, i: r[i]))"
    return f"""sq{n} as (select 0 as k, {matrix} union all select k + 1, {product.replace('list_dot_product(r, s)', f'list_dot_product(r, s) / ({trace} * {trace})')} from sq{n} where k < 40),
        top{n} as (select m[list_position(list_transform(m, lambda r, i: r[i]), list_max(list_transform(m, lambda r, i: r[i])))] as r from sq{n} where k = 40),
        vec{n} as (select list_transform(r, lambda x: x / sqrt(list_dot_product(r, r)) * sign(r[list_position(list_transform(r, lambda y: abs(y)), list_max(list_transform(r, lambda y: abs(y))))])) as v from top{n})"""


_DEFLATED = """list_transform(m, lambda r, i: list_transform(r, lambda x, j: x - v[i] * v[j] * list_dot_product(v, list_transform(m, lambda q: list_dot_product(q, v))))) as m
    from (select m, v from cov, vec1)"""


@query(
    "pca2",
    f"""with recursive x as (select vec_id, unnest(embedding)::double as e, generate_subscripts(embedding, 1) as i from embeddings),
        z as (select vec_id, i, e - avg(e) over (partition by i) as e from x),
        c as (select a.i, b.i as j, sum(a.e * b.e) / (count(*) - 1) as c from z a join z b using (vec_id) group by all),
        cov as (select list(r order by i) as m from (select i, list(c order by j) as r from c group by i)),
        {_leading(1, 'm from cov')}, {_leading(2, _DEFLATED)}
        select vec_id, label, round(list_dot_product(embedding::double[], vec1.v), 6) as pc1, round(list_dot_product(embedding::double[], vec2.v), 6) as pc2
        from embeddings, vec1, vec2""",
)
def pca2(spark, sf):
    return rounded(
        clusters.pca(table(spark, sf, "embeddings"), "embedding", 2).select(
            "vec_id", "label", F.col("projected")[0].alias("pc1"), F.col("projected")[1].alias("pc2")
        )
    )


@query("kmeans_topics")
def kmeans_topics(spark, sf):
    points = _points(spark, sf).withColumn("embedding", l2_normalize("embedding"))
    return clusters.slice_topics(points, ["lang"], "embedding", 8, 10).groupBy("lang", "topic").agg(F.count(F.lit(1)).alias("n"))


@query(
    "document_frequency",
    f"select token, count(*) as df from (select doc_id, unnest(list_distinct({_WORDS})) as token from documents) group by 1",
)
def document_frequency(spark, sf):
    return ops.document_frequency(texts(spark, sf), "text")


_TFIDF = f"""tf as (select doc_id, lang, token, count(*) as tf from (select doc_id, lang, unnest({_WORDS}) as token from documents) group by all),
    df as (select token, ln(((select count(*) from documents) + 1) / (count(*) + 1)) as idf from tf group by 1),
    w as (select doc_id, lang, token, tf * idf as w from tf join df using (token)),
    u as (select doc_id, lang, token, w / sqrt(sum(w * w) over (partition by doc_id)) as w from w qualify sum(w * w) over (partition by doc_id) > 0)"""


@query("tfidf", f"with {_TFIDF} select doc_id, token, round(w, 6) as w from u")
def tfidf(spark, sf):
    return rounded(ops.tfidf(texts(spark, sf), "doc_id", "text"))


@query(
    "tfidf_silhouette",
    f"""with {_TFIDF}, n as (select lang, count(*) as n from documents group by 1),
        mu as (select lang as c, token, sum(w) / any_value(n) as mu from u join n using (lang) group by all),
        d as (select doc_id, lang, c, sum(w * mu) as dot from u join mu using (token) group by all),
        b as (select doc_id, max(dot) filter (c = lang) as own, coalesce(max(dot) filter (c <> lang), 0) as other from d group by 1),
        s as (select d.lang, n, greatest(1 - own, 0) * n / (n - 1) as a, 1 - other as b from documents d join n using (lang) left join b using (doc_id))
       select round(avg(case when a is null then 0 when n = 1 then 0 when greatest(a, b) > 0 then (b - a) / greatest(a, b) else 0 end), 6) as silhouette,
          count(*) as n, count(distinct lang) as n_labels from s""",
)
def tfidf_silhouette(spark, sf):
    return rounded(ops.tfidf_silhouette(texts(spark, sf), "doc_id", "text", "lang"))
