"""Matching, agreement, summary and entropy queries on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import words
from ..operators import agreement, matching, models, ranks
from ..operators import summaries as ops
from .conformity_queries import _SCORES as _CONFORMITY
from .conformity_queries import scored_vectors
from .registry import query, rounded, table

_CHARGED = "('PROMO', 'ECONOMY', 'SMALL')"


def _graded(spark, sf):
    """Lineitem as graded responses: the return flag is the system, the line status the depth."""
    return table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("system"),
        F.col("l_linestatus").alias("depth"),
        (F.col("l_tax") > 0.04).alias("is_critical"),
        (F.col("l_quantity") > 25).cast("int").alias("correct"),
    )


_GRADED = """g as (select l_returnflag as system, l_linestatus as depth, l_tax > 0.04 as is_critical,
    (l_quantity > 25)::int as correct from lineitem)"""


@query(
    "accuracy_summary",
    f"with {_GRADED} select system, depth, is_critical, round(avg(correct), 6) as accuracy, count(*) as n from g group by all",
)
def accuracy_summary(spark, sf):
    return rounded(ops.accuracy(_graded(spark, sf), ["system", "depth", "is_critical"]))


@query(
    "accuracy_panels",
    f"""with {_GRADED} select system, depth, round(avg(correct) filter (is_critical), 6) as critical,
        round(avg(correct) filter (not is_critical), 6) as non_critical from g group by all""",
)
def accuracy_panels(spark, sf):
    return rounded(ops.accuracy_panels(_graded(spark, sf), ["system", "depth"], "is_critical"))


@query(
    "response_accuracy",
    r"""with a as (select conv_id, turn, text, lag(text) over (partition by conv_id order by turn) as prompt,
                first(text) over (partition by conv_id order by turn) as opening, role from conversations),
        r as (select distinct conv_id, turn, conv_id % 3 as m, text, opening, unnest(regexp_extract_all(lower(prompt), '[\p{L}\p{M}]+')) as truth
              from a where role = 'assistant'),
        s as (select 'model-' || m as system, contains(lower(text), truth)::int as correct from r
              union all select 'gpt2_xl', contains(lower(opening), truth)::int from r)
       select system, round(avg(correct), 6) as accuracy, count(*) as n from s group by 1""",
)
def response_accuracy(spark, sf):
    # Every word of the turn before is a truth; the baseline answers with the conversation's first turn.
    turns = table(spark, sf, "conversations")
    truth = F.explode(F.array_distinct(words("text"))).alias("ground_truth")
    before = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), truth)
    opening = turns.groupBy("conv_id").agg(F.min_by("text", "turn").alias("opening"))
    answers = turns.filter(F.col("role") == "assistant").join(before, ["conv_id", "turn"]).join(opening, "conv_id")
    model = F.concat(F.lit("model-"), (F.col("conv_id") % 3).cast("string")).alias("model")
    responses = answers.select(model, "ground_truth", F.col("text").alias("response"))
    baseline = answers.select(model, "ground_truth", F.col("opening").alias("response"))
    return rounded(ops.accuracy(ops.scored_responses(ops.with_baseline(responses, baseline)), ["system"]))


@query(
    "vs_baseline",
    f"""with {_GRADED}, c as (select system, depth, is_critical, avg(correct) as accuracy, count(*) as n from g group by all)
        select a.system, depth, is_critical, round(a.accuracy, 6) as accuracy, a.n, round(b.accuracy, 6) as baseline_accuracy,
           round(a.accuracy - b.accuracy, 6) as gain
        from c a left join (select * from c where system = 'N') b using (depth, is_critical) where a.system <> 'N'""",
)
def vs_baseline(spark, sf):
    cells = ops.accuracy(_graded(spark, sf), ["system", "depth", "is_critical"])
    return rounded(ops.versus_baseline(cells, ["depth", "is_critical"], "N"))


@query(
    "mean_sem",
    """select o_orderstatus as domain, o_orderpriority as level, round(avg(o_totalprice), 4) as mean,
          round(stddev_samp(o_totalprice) / sqrt(count(*)), 4) as sem, count(*) as n from orders group by all""",
)
def mean_sem(spark, sf):
    df = table(spark, sf, "orders").withColumnsRenamed({"o_orderstatus": "domain", "o_orderpriority": "level"})
    return rounded(ops.mean_and_sem(df, ["domain", "level"], "o_totalprice"), 4)


@query("stratum_counts", "select lang, source, count(*) as n from documents group by all")
def stratum_counts(spark, sf):
    return ops.group_counts(table(spark, sf, "documents"), ["lang", "source"])


@query("distinct_counts", "select count(distinct lang) as n_lang, count(distinct source) as n_source from documents")
def distinct_counts(spark, sf):
    return ops.distinct_counts(table(spark, sf, "documents"), "lang", "source")


@query("min_group", "select source, lang, count(*) as n from documents group by all having count(*) >= 10")
def min_group(spark, sf):
    return ops.large_groups(table(spark, sf, "documents"), ["source", "lang"])


@query(
    "band_stats",
    """select p_type, min(p_size) as p_size_min, max(p_size) as p_size_max, round(avg(p_size), 6) as p_size_mean,
          min(p_retailprice) as p_retailprice_min, max(p_retailprice) as p_retailprice_max, round(avg(p_retailprice), 6) as p_retailprice_mean
       from part group by 1""",
)
def band_stats(spark, sf):
    return rounded(ops.range_stats(table(spark, sf, "part"), ["p_type"], "p_size", "p_retailprice"))


@query(
    "cell_counts",
    """with f as (select * from (select unnest(['en', 'de', 'fr', 'es', 'it']) as lang), (select unnest(['src0', 'src1', 'src2', 'src19', 'none']) as source)),
        d as (select case when lang in ('en', 'de', 'fr', 'es', 'it') then lang end as lang,
                case when source in ('src0', 'src1', 'src2', 'src19', 'none') then source end as source from documents),
        u as (select lang, source, 0 as k from f union all select lang, source, 1 from d)
       select lang, source, sum(k)::bigint as n, sum(k) < 10 as too_small from u group by all""",
)
def cell_counts(spark, sf):
    factors = {"lang": ["en", "de", "fr", "es", "it"], "source": ["src0", "src1", "src2", "src19", "none"]}
    return ops.cell_counts(table(spark, sf, "documents"), factors)


@query(
    "level_gain",
    """with g as (select l_linestatus as complexity, l_suppkey as domain,
              avg(l_extendedprice) filter (l_linenumber = 4) - avg(l_extendedprice) filter (l_linenumber = 1) as gain from lineitem group by all)
       select complexity, round(avg(gain), 4) as mean_gain, count(gain) as n_domains from g group by 1""",
)
def level_gain(spark, sf):
    df = table(spark, sf, "lineitem").withColumnsRenamed({"l_linestatus": "complexity", "l_suppkey": "domain"})
    level = df.withColumn("level", F.col("l_linenumber") - 1)
    return rounded(ops.level_gain(level, "domain", "complexity", "level", "l_extendedprice"), 4)


@query(
    "log_totals",
    """select event_type as model, count(*) as n_calls, coalesce(sum(case when value < 20 then (props->>'$.k')::bigint end), 0)::bigint as prompt_tokens,
          coalesce(sum(case when value < 20 then event_id % 50 end), 0)::bigint as completion_tokens from events group by 1""",
)
def log_totals(spark, sf):
    # Calls of a high value stand for those whose provider reported no usage.
    tokens = F.get_json_object("props", "$.k").cast("bigint")
    usage = F.when(F.col("value") < 20, F.struct(tokens.alias("prompt_tokens"), (F.col("event_id") % 50).alias("completion_tokens")))
    calls = table(spark, sf, "events").select(F.col("event_type").alias("model"), usage.alias("usage"))
    return ops.log_totals(calls, ["model"])


@query(
    "replication",
    """with m as (select l_suppkey as finding, l_returnflag as model, avg(l_quantity) as v from lineitem group by all)
       select finding, bool_and(v > 25) as replicates, count(*) filter (v > 25) as n_holding, count(distinct model) as n_units from m group by 1""",
)
def replication(spark, sf):
    per_model = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("finding"), F.col("l_returnflag").alias("model")).agg(
        F.avg("l_quantity").alias("v")
    )
    return ops.replication(per_model, "finding", "model", F.col("v") > 25)


@query(
    "adjudication",
    """with o as (select l_suppkey as study, ['E1', 'E2', 'E3', 'E3U', 'E4', 'E5'][(l_linenumber - 1) % 6 + 1] as experiment,
                  avg(l_quantity) > 25.5 as confirmed from lineitem group by all),
        w as (select study, bool_and(confirmed) filter (experiment = 'E1') as e1, bool_and(confirmed) filter (experiment = 'E2') as e2,
                bool_and(confirmed) filter (experiment = 'E3') as e3, bool_and(confirmed) filter (experiment = 'E3U') as e3u,
                bool_and(confirmed) filter (experiment = 'E4') as e4, bool_and(confirmed) filter (experiment = 'E5') as e5
              from o group by 1)
       select study, case when e4 and e1 then 'confirmed' when e4 and not e1 then 'restricted' when not e4 and e1 then 'disconfirmed' when not e4 and not e1 then 'fully disconfirmed' else 'undetermined' end as thesis1,
         case when e2 and e5 then 'confirmed' when e2 and not e5 then 'synchronic only' when not e2 and e5 then 'diachronic only' when not e2 and not e5 then 'disconfirmed' else 'undetermined' end as thesis2,
         case when e3 and e3u then 'inequality' when e3 and not e3u then 'quality differential' when not e3 then 'disconfirmed' else 'undetermined' end as thesis3 from w""",
)
def adjudication(spark, sf):
    names = F.array(*[F.lit(e) for e in ("E1", "E2", "E3", "E3U", "E4", "E5")])
    line = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("study"), F.element_at(names, (F.col("l_linenumber") - 1) % 6 + 1).alias("experiment"), "l_quantity"
    )
    outcomes = line.groupBy("study", "experiment").agg((F.avg("l_quantity") > 25.5).alias("confirmed"))
    return ops.adjudicate(outcomes, ["study"])


@query(
    "overcoding_verdict",
    f"""with {_CONFORMITY}, c as (select label, avg(conformity) as m from scored group by 1),
        e as (select e.label, count(distinct d.source) as k from embeddings e join documents d on d.doc_id = e.vec_id group by 1)
       select label, case when m > 0.5 then 'confirmed' when k <= 18 then 'anomalous' else 'disconfirmed' end as verdict from c join e using (label)""",
)
def overcoding_verdict(spark, sf):
    vectors = table(spark, sf, "embeddings")
    means = scored_vectors(spark, sf).groupBy("label").agg(F.avg("conformity").alias("m"))
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), "source")
    spread = vectors.select("vec_id", "label").join(docs, "vec_id").groupBy("label").agg(F.count_distinct("source").alias("k"))
    return means.join(spread, "label").select("label", ops.overcoding_verdict(F.col("m") > 0.5, F.col("k") > 18).alias("verdict"))


# --- topics -----------------------------------------------------------------

_TOPIC = "t as (select d.doc_id, d.source, d.lang, e.label as topic from documents d join embeddings e on d.doc_id = e.vec_id)"


def _topics(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source", "lang")
    return docs.join(table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("label").alias("topic")), "doc_id")


@query(
    "topics_min_size",
    f"""with {_TOPIC}, c as (select lang, topic, count(*) as n from t group by all)
        select doc_id, lang, case when n < 10 then -1 else topic end::int as topic from t join c using (lang, topic)""",
)
def topics_min_size(spark, sf):
    return ops.drop_small_topics(_topics(spark, sf), ["lang"], "topic", 10).select("doc_id", "lang", "topic")


_ENTROPY = f"""{_TOPIC}, c as (select source, lang, topic, count(*) as n from t group by all),
    p(config, min_size) as (values ('conservative', 15), ('default', 10), ('fine_grained', 5)),
    m as (select source, config, case when n < min_size then -1 else topic end as topic, sum(n) as n
          from (select source, topic, sum(n) as n from c group by all), p group by all),
    s as (select *, n / sum(n) over (partition by source, config) as p from m),
    ent as (select source, config, coalesce(sum(-p * log2(p)) filter (topic <> -1), 0) as entropy from s group by all)"""


@query(
    "topic_entropy",
    f"""with {_TOPIC}, c as (select source, topic, count(*) as n from t group by all),
        s as (select *, n / sum(n) over (partition by source) as p from c)
        select source, round(sum(-p * log2(p)), 6) as entropy from s group by 1""",
)
def topic_entropy(spark, sf):
    return rounded(ops.topic_entropy(_topics(spark, sf), ["source"], "topic"))


@query("preset_entropy", f"with {_ENTROPY} select source, config, round(entropy, 6) as entropy from ent")
def preset_entropy(spark, sf):
    return rounded(ops.preset_entropy(_topics(spark, sf), ["source"], "topic"))


@query(
    "entropy_renormalized",
    f"""with {_TOPIC}, c as (select lang, topic, count(*) as n from t group by all),
        k as (select lang, topic, n / sum(n) over (partition by lang) as p from c where n >= 10),
        l as (select distinct lang from c)
        select lang, round(coalesce(sum(-p * log2(p)), 0), 6) as entropy from l left join k using (lang) group by 1""",
)
def entropy_renormalized(spark, sf):
    counts = ops.topic_counts(_topics(spark, sf), ["lang"], "topic", {"default": 10})
    return rounded(ops.entropy_of_counts(counts, ["lang"], "topic", renormalize=True))


@query(
    "config_pivot",
    f"""with {_ENTROPY} select source, round(avg(entropy) filter (config = 'conservative'), 6) as conservative,
          round(avg(entropy) filter (config = 'default'), 6) as "default", round(avg(entropy) filter (config = 'fine_grained'), 6) as fine_grained
        from ent group by 1""",
)
def config_pivot(spark, sf):
    return rounded(ops.config_pivot(ops.preset_entropy(_topics(spark, sf), ["source"], "topic"), ["source"]))


@query(
    "entropy_by_generation",
    """with c as (select year(o_orderdate)::int as generation, o_orderstatus as kind, o_orderpriority as topic, count(*) as n from orders group by all),
        s as (select *, n / sum(n) over (partition by generation, kind) as p from c)
       select generation, kind, round(sum(-p * log2(p)), 6) as entropy from s group by 1, 2""",
)
def entropy_by_generation(spark, sf):
    df = table(spark, sf, "orders").select(
        F.year("o_orderdate").alias("generation"),
        F.col("o_orderstatus").alias("kind"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("topic"),
    )
    return rounded(ops.topic_entropy(df, ["generation", "kind"], "topic"))


@query(
    "entropy_ols",
    """with c as (select o_custkey as concept, year(o_orderdate) - 1995 as charge, o_orderpriority as topic, count(*) as n from orders group by all),
        s as (select *, n / sum(n) over (partition by concept, charge) as p from c),
        e as (select concept, charge, round(sum(-p * log2(p)), 9) as h from s group by 1, 2)
       select count(*) as n, round(regr_slope(h, charge), 6) as coef, round(regr_r2(h, charge), 6) as r2 from e""",
)
def entropy_ols(spark, sf):
    # The year stands for the charge rating of a concept.
    topics = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("concept"),
        (F.year("o_orderdate") - 1995).alias("charge"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("topic"),
    )
    entropies = ops.topic_entropy(topics, ["concept", "charge"], "topic")
    fit = models.ols(entropies, "entropy", {"charge": F.col("charge")})
    return rounded(fit.filter("term = 'charge'").select("n", "coef", "r2"))


# --- effort, boxes ----------------------------------------------------------


@query(
    "effort_ratio",
    """with e as (select min(l_extendedprice) a, max(l_extendedprice) b, min(l_linenumber) c, max(l_linenumber) d, min(l_quantity) e, max(l_quantity) f from lineitem),
        n as (select l_orderkey, l_partkey, l_linenumber, (l_extendedprice - a) / (b - a + 1e-9) + (l_linenumber - c) / (d - c + 1e-9)
                + (l_quantity - e) / (f - e + 1e-9) as effort, l_discount * 100 + 1 as q from lineitem, e)
       select l_orderkey, l_partkey, l_linenumber, round(effort, 6) as effort, round(effort / (q + 1e-9), 6) as effort_to_quality from n""",
)
def effort_ratio(spark, sf):
    df = table(spark, sf, "lineitem").withColumn("quality", F.col("l_discount") * 100 + 1)
    scaled = ops.effort_to_quality(df, ["l_extendedprice", "l_linenumber", "l_quantity"], "quality")
    return rounded(scaled.select("l_orderkey", "l_partkey", "l_linenumber", "effort", "effort_to_quality"))


@query(
    "box_summary",
    """with q as (select l_returnflag, quantile_cont(l_extendedprice, 0.25) as q1, quantile_cont(l_extendedprice, 0.5) as median,
                  quantile_cont(l_extendedprice, 0.75) as q3, count(*) as n from lineitem group by 1)
       select l_returnflag, round(q1, 6) as q1, round(median, 6) as median, round(q3, 6) as q3, n,
         min(l_extendedprice) filter (l_extendedprice >= q1 - 1.5 * (q3 - q1)) as whisker_low,
         max(l_extendedprice) filter (l_extendedprice <= q3 + 1.5 * (q3 - q1)) as whisker_high,
         count(*) filter (not (l_extendedprice between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1))) as n_outliers
       from lineitem join q using (l_returnflag) group by l_returnflag, q1, median, q3, n""",
)
def box_summary(spark, sf):
    return rounded(ranks.box_summary(table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice"))


# --- matching and agreement -------------------------------------------------


@query(
    "matched_pairs",
    """with c as (select p_partkey, p_retailprice, length(p_name) as len from part)
       select a.p_partkey as charged_id, b.p_partkey as control_id, round(abs(a.p_retailprice - b.p_retailprice) / a.p_retailprice, 6) as frequency_gap,
         round(abs(a.len - b.len) / a.len, 6) as length_gap,
         abs(a.p_retailprice - b.p_retailprice) / a.p_retailprice <= 0.15 and abs(a.len - b.len) / a.len <= 0.20 as within
       from c a join c b on b.p_partkey = a.p_partkey + 1""",
)
def matched_pairs(spark, sf):
    concepts = table(spark, sf, "part").select(
        "p_partkey", (F.col("p_partkey") + 1).alias("control"), "p_retailprice", F.length("p_name").alias("len")
    )
    return rounded(matching.matched_pairs(concepts, "p_partkey", "control", "p_retailprice", "len"))


@query(
    "control_search",
    f"""with c as (select p_partkey, floor(p_retailprice / 4) / 100 as zipf, p_size, p_type in {_CHARGED} as charged from part),
        f as (select a.p_partkey, b.p_partkey as id, abs(a.zipf - b.zipf) / a.zipf as fg, abs(a.p_size - b.p_size) / a.p_size as lg
              from c a join c b on a.charged and not b.charged and abs(a.zipf - b.zipf) / a.zipf <= 0.15 and abs(a.p_size - b.p_size) / a.p_size <= 0.20),
        g as (select p_partkey, count(*) as n, arg_min(id, (fg, lg, id)) as id from f group by 1)
        select p_partkey, zipf, p_size, coalesce(n, 0) as n_controls, id as control_id from c left join g using (p_partkey) where charged""",
)
def control_search(spark, sf):
    concepts = table(spark, sf, "part").select("p_partkey", (F.floor(F.col("p_retailprice") / 4) / 100).alias("zipf"), "p_size", "p_type")
    is_charged = F.col("p_type").isin("PROMO", "ECONOMY", "SMALL")
    charged = concepts.filter(is_charged).drop("p_type")
    return matching.control_search(charged, concepts.filter(~is_charged), "p_partkey", "zipf", "p_size")


def _concepts(spark, sf):
    concepts = table(spark, sf, "part").select("p_partkey", F.col("p_retailprice").alias("price"), "p_size", "p_type")
    is_charged = F.col("p_type").isin("PROMO", "ECONOMY", "SMALL")
    return concepts.filter(is_charged).drop("p_type"), concepts.filter(~is_charged)


@query(
    "control_counts",
    f"""with c as (select p_partkey, p_retailprice as price, p_size, p_type in {_CHARGED} as charged from part),
        f as (select a.p_partkey, count(*) as n from c a join c b
              on a.charged and not b.charged and abs(a.price - b.price) / a.price <= 0.15 and abs(a.p_size - b.p_size) / a.p_size <= 0.20 group by 1)
        select p_partkey, price, p_size, coalesce(n, 0) as n_controls from c left join f using (p_partkey) where charged""",
)
def control_counts(spark, sf):
    charged, controls = _concepts(spark, sf)
    return matching.control_counts(charged, controls, "price", "p_size")


@query(
    "control_candidates",
    f"""with c as (select p_partkey, p_retailprice as price, p_size, p_type in {_CHARGED} as charged from part)
        select a.p_partkey as charged_id, b.p_partkey as control_id, round(abs(a.price - b.price) / a.price, 6) as frequency_gap,
          round(abs(a.p_size - b.p_size) / a.p_size, 6) as length_gap
        from c a join c b on a.charged and not b.charged and abs(a.price - b.price) / a.price <= 0.15 and abs(a.p_size - b.p_size) / a.p_size <= 0.20""",
)
def control_candidates(spark, sf):
    charged, controls = _concepts(spark, sf)
    return rounded(matching.control_candidates(charged, controls, "p_partkey", "price", "p_size"))


@query(
    "kappa",
    """with r as (select case l_returnflag when 'A' then 'F' when 'R' then 'F' else 'O' end as a, l_linestatus as b from lineitem),
        c as (select a, b, count(*) as n from r group by all), t as (select sum(n) as n, sum(n) filter (a = b) as agree from c),
        e as (select sum(x.n::double * y.n) as s from (select a as k, sum(n) as n from c group by 1) x join (select b as k, sum(n) as n from c group by 1) y using (k))
       select n::bigint as n, round(agree / n, 6) as observed, round(s / (n::double * n), 6) as expected,
          round((agree / n - s / (n::double * n)) / (1 - s / (n::double * n)), 6) as kappa from t, e""",
)
def kappa(spark, sf):
    rated = table(spark, sf, "lineitem").select(
        F.when(F.col("l_returnflag") == "N", "O").otherwise("F").alias("a"), F.col("l_linestatus").alias("b")
    )
    return rounded(agreement.cohen_kappa(rated, "a", "b"))


@query(
    "pairwise_kappa",
    """with r as (select doc_id, lang, quality as a, toxic as b, (n_chars > 800)::int as c from labels join documents using (doc_id)),
        l as (select doc_id, unnest(['ab', 'ac', 'bc']) as p, unnest([a, a, b]) as x, unnest([b, c, c]) as y from r),
        t as (select p, count(*) as n, avg((x = y)::int) as observed, avg(x) * avg(y) + (1 - avg(x)) * (1 - avg(y)) as expected from l group by 1)
       select p[1] as rater_a, p[2] as rater_b, n, round(observed, 6) as observed, round(expected, 6) as expected,
          round((observed - expected) / (1 - expected), 6) as kappa from t""",
)
def pairwise_kappa(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", (F.col("n_chars") > 800).cast("int").alias("c"))
    wide = table(spark, sf, "labels").withColumnsRenamed({"quality": "a", "toxic": "b"}).join(docs, "doc_id")
    long = wide.unpivot(["doc_id"], ["a", "b", "c"], "rater", "score")
    pivoted = agreement.ratings_wide(long, "doc_id", "rater", "score", ["a", "b", "c"])
    return rounded(agreement.pairwise_kappa(pivoted, ["a", "b", "c"]))


@query(
    "fleiss",
    """with c as (select l_orderkey, l_returnflag, count(*) as n from lineitem group by all),
        i as (select l_orderkey, sum(n) as m, sum(n * n) as ss from c group by 1 having sum(n) >= 2),
        o as (select avg((ss - m) / (m * (m - 1))) as observed, count(*) as n_items, sum(m) as n_ratings from i),
        e as (select sum(n::double * n) / sum(n)::double ** 2 as expected from (select l_returnflag, sum(n) as n from c join i using (l_orderkey) group by 1))
       select n_items, n_ratings::bigint as n_ratings, round(observed, 6) as observed, round(expected, 6) as expected,
          round((observed - expected) / (1 - expected), 6) as kappa from o, e""",
)
def fleiss(spark, sf):
    return rounded(agreement.fleiss_kappa(table(spark, sf, "lineitem"), "l_orderkey", "l_returnflag"))


@query(
    "icc21",
    """with w as (select l_quantity as a, l_quantity + l_discount * 100 as b, l_quantity - l_tax * 100 as c from lineitem),
        m as (select avg(a) as ma, avg(b) as mb, avg(c) as mc, avg((a + b + c) / 3) as g, count(*) as n from w),
        s as (select 3 * sum(((a + b + c) / 3 - g) ** 2) as ssr, any_value(n * ((ma - g) ** 2 + (mb - g) ** 2 + (mc - g) ** 2)) as ssc,
                sum((a - g) ** 2 + (b - g) ** 2 + (c - g) ** 2) as sst, any_value(n) as n from w, m),
        q as (select n, ssr / (n - 1) as r, ssc / 2 as c, (sst - ssr - ssc) / (2 * (n - 1)) as e from s)
       select n, round(r, 6) as ms_items, round(c, 4) as ms_raters, round(e, 6) as ms_error, round((r - e) / (r + 2 * e + 3 * (c - e) / n), 6) as icc from q""",
)
def icc21(spark, sf):
    wide = table(spark, sf, "lineitem").select(
        F.col("l_quantity").alias("a"), (F.col("l_quantity") + F.col("l_discount") * 100).alias("b"), (F.col("l_quantity") - F.col("l_tax") * 100).alias("c")
    )
    result = agreement.icc21(wide, ["a", "b", "c"])
    return rounded(result.withColumn("ms_raters", F.round("ms_raters", 4)))


@query(
    "mcnemar",
    """with c as (select count(*) filter (quality = 1 and toxic = 1) as both, count(*) filter (quality = 1 and toxic = 0) as only_first,
                  count(*) filter (quality = 0 and toxic = 1) as only_second, count(*) filter (quality = 0 and toxic = 0) as neither from labels)
       select *, round((only_first - only_second) ** 2 / (only_first + only_second), 6) as chi2 from c""",
)
def mcnemar(spark, sf):
    return rounded(agreement.mcnemar(table(spark, sf, "labels"), "quality", "toxic"))
