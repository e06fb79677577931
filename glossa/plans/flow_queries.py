"""The analyses of ``experiments`` and the operators they begin with, bound to the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import conformity as cf
from ..operators import design, lexical
from ..session import shared_dir
from ..sources import files
from ..sources.schemas import SCORE_FIELDS
from . import experiments
from .conformity_queries import _CENTROIDS, _SCORES
from .registry import query, rounded, table
from .summary_queries import _topics

_LIBRARY = "l as (select 'exp' || (p_partkey // 50) as experiment, p_brand as part, p_partkey::varchar as name, p_type || ': ' || p_name as text from part)"


@query(
    "prompt_library",
    f"""with {_LIBRARY} select experiment, part, name, text from l
        union all select 'direct' || (p_partkey // 1000), null, p_partkey::varchar, p_name || ' {{target}}' from part where p_size = 1""",
)
def prompt_library(spark, sf):
    # Libraries of at most 50 texts, and some whose templates stand directly under their experiment; one file each.
    part = table(spark, sf, "part")
    name, text = F.col("p_partkey").cast("string").alias("name"), F.concat("p_type", F.lit(": "), "p_name").alias("text")
    rows = part.select(F.concat(F.lit("exp"), F.floor(F.col("p_partkey") / 50)).alias("experiment"), F.col("p_brand").alias("part"), name, text)
    collected = lambda key, value: F.map_from_entries(F.collect_list(F.struct(key, value)))
    parts = rows.groupBy("experiment", "part").agg(collected("name", "text").alias("body"))
    nested = parts.groupBy("experiment").agg(collected("part", "body").alias("body"))
    direct = part.filter("p_size = 1").select(F.concat(F.lit("direct"), F.floor(F.col("p_partkey") / 1000)).alias("experiment"), name, F.concat("p_name", F.lit(" {target}")).alias("text"))
    direct = direct.groupBy("experiment").agg(collected("name", "text").alias("body"))
    path = shared_dir(spark, "prompts")
    for made, folder in ((nested, "nested"), (direct, "direct")):
        lines = made.select(F.col("experiment").alias("file"), F.to_json(F.create_map("experiment", "body")).alias("value"))
        lines.write.partitionBy("file").text(f"{path}/kind={folder}")
    return files.read_prompts(spark, path)


@query(
    "judge_requests",
    """with r(model, judge_model) as (values ('BUILDING', 'MACHINERY'), ('BUILDING', 'HOUSEHOLD'), ('MACHINERY', 'BUILDING'), ('HOUSEHOLD', 'BUILDING'))
       select c_custkey, judge_model, 'Field ' || n_nationkey || ', known: ' || n_name || ', said: ' || c_name as judge_prompt
       from customer join r on c_mktsegment = model join nation on c_nationkey = n_nationkey and n_regionkey <> 1""",
)
def judge_requests(spark, sf):
    responses = table(spark, sf, "customer").select(
        "c_custkey", F.col("c_nationkey").alias("domain"), F.col("c_mktsegment").alias("model"), F.col("c_name").alias("response")
    )
    truth = table(spark, sf, "nation").filter("n_regionkey <> 1").select(F.col("n_nationkey").alias("domain"), F.col("n_name").alias("ground_truth"))
    routes = {"BUILDING": ["MACHINERY", "HOUSEHOLD"], "MACHINERY": "BUILDING", "HOUSEHOLD": "BUILDING"}
    asked = experiments.judge_requests(responses, truth, "Field {domain}, known: {ground_truth}, said: {response}", routes)
    return asked.select("c_custkey", "judge_model", "judge_prompt")


@query(
    "critical_listing",
    "select o_orderkey, o_orderpriority from orders where o_orderstatus = 'F' and o_totalprice > 300000 order by o_orderpriority, o_orderkey",
)
def critical_listing(spark, sf):
    critical = (F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 300000)
    orders = table(spark, sf, "orders").withColumn("is_critical_item", critical)
    return lexical.critical_listing(orders, "o_orderpriority", "o_orderkey").select("o_orderkey", "o_orderpriority")


_CHANGING = ", ".join(f"('{c}')" for c in design.CHANGING_CONCEPTS)


@query(
    "diachronic_concepts",
    f"""with c(concept) as (values {_CHANGING})
        select concept, 'changing' as concept_type from c
        union all select concept, 'stable' from (select p_name || ' ' || p_partkey as concept from part where p_size % 2 = 0 order by p_partkey limit 10)""",
)
def diachronic_concepts(spark, sf):
    concepts = table(spark, sf, "part").select(
        F.col("p_partkey").alias("concept_id"),
        F.concat_ws(" ", "p_name", "p_partkey").alias("concept"),
        F.when(F.col("p_size") % 2 == 0, "control").otherwise("charged").alias("concept_type"),
    )
    return design.diachronic_concepts(concepts)


@query(
    "feature_prototypes",
    f"""with {_CENTROIDS}, m as (select source, label, count(*) as k from documents join embeddings on doc_id = vec_id group by all),
        t as (select source, label from m qualify row_number() over (partition by source order by k desc, label) <= 3),
        e as (select source, unnest(prototype) as v, generate_subscripts(prototype, 1) as pos from t join proto using (label)),
        a as (select source, pos, avg(v) as v from e group by all)
       select source, count(*) as dim, round(sum(v), 6) as total, round(max(v), 6) as most from a group by 1""",
)
def feature_prototypes(spark, sf):
    features = cf.centroids(table(spark, sf, "embeddings"), ["label"], "embedding", "vector").select(F.col("label").alias("topic"), "vector")
    protos = cf.feature_prototypes(_topics(spark, sf), features, ["source"], "topic", "vector", 3)
    total = F.aggregate("prototype", F.lit(0.0), lambda a, v: a + v)
    return rounded(protos.select("source", F.size("prototype").cast("bigint").alias("dim"), total.alias("total"), F.array_max("prototype").alias("most")))


# --- flows ------------------------------------------------------------------

_DOMAINS = ", ".join(f"'{d}'" for d in design.DOMAIN_COMPLEXITY)


def _quality(spark, sf):
    """Judge replies over the request table of a few domains: scores follow the line items, some replies are unusable."""
    # Literals, whose size Spark knows: the few requests go to the line items, which stay where they are read.
    domains = spark.range(1).select(F.explode(F.array(*[F.lit(d) for d in design.DOMAIN_COMPLEXITY])).alias("domain"))
    requests = experiments.domain_requests(domains, ["m"]).filter("response_index = 0").drop("response_index")
    names = F.array(*[F.lit(d) for d in design.DOMAIN_COMPLEXITY])
    line = table(spark, sf, "lineitem").select(F.element_at(names, (F.col("l_partkey") % 10 + 1).cast("int")).alias("domain"), "l_linenumber", "l_quantity")
    score = (F.col("l_quantity") % 5 + 1).cast("int")
    body = F.to_json(F.struct(*[score.alias(c) for c in SCORE_FIELDS], F.lit("x").alias("brief_justification")))
    reply = F.when(F.col("l_linenumber") == 7, F.lit("no json")).otherwise(body)
    return experiments.quality_analysis(requests.join(line.select("domain", reply.alias("reply")), "domain"))


_QUALITY = f"""d as (select unnest([{_DOMAINS}]) as domain, unnest(range(10)) as k),
    f as (select unnest([{', '.join(repr(d) for d in design.FOCAL_DOMAINS)}]) as domain),
    bits as (select unnest(range(16)) as b),
    q as (select domain, case b when 0 then 0 when 1 then 1 when 7 then 2 when 15 then 3 end as level from f, bits
          union all select domain, l from d, (select unnest([0, 1, 2, 3]) as l) where domain not in (select domain from f)),
    s as (select domain, level, (l_quantity::int % 5 + 1)::double as quality, l_linenumber from q join d using (domain) join lineitem on l_partkey % 10 = k)"""


@query(
    "quality_curves",
    f"""with {_QUALITY} select domain, level::int as level, round(avg(quality), 6) as mean, round(stddev_samp(quality) / sqrt(count(*)), 6) as sem, count(*) as n
        from s where l_linenumber <> 7 group by all""",
)
def quality_curves(spark, sf):
    return rounded(_quality(spark, sf)["curves"])


@query("quality_quarantine", f"with {_QUALITY} select domain, count(*) as n from s where l_linenumber = 7 group by 1")
def quality_quarantine(spark, sf):
    return _quality(spark, sf)["quarantine"].groupBy("domain").agg(F.count(F.lit(1)).alias("n"))


@query(
    "accuracy_flow",
    """with l as (select case l_returnflag when 'A' then 'gpt2_xl' when 'N' then 'gpt4o' else 'llama' end as system,
              case l_linenumber % 3 when 0 then 'shallow' when 1 then 'medium' else 'deep' end as inferential_depth, l_tax > 0.04 as is_critical_item,
              (l_quantity::int % (2 + l_linenumber) < 2)::int as correct from lineitem where l_linestatus = 'O' or l_returnflag = 'A'),
        a as (select system, inferential_depth, is_critical_item, avg(correct) as accuracy, count(*) as n from l group by all)
       select m.system, m.inferential_depth, m.is_critical_item, round(m.accuracy, 6) as accuracy, m.n, round(m.accuracy - b.accuracy, 6) as gain
       from a m join a b using (inferential_depth, is_critical_item) where b.system = 'gpt2_xl' and m.system <> 'gpt2_xl'""",
)
def accuracy_flow(spark, sf):
    depth = F.element_at(F.array(F.lit("shallow"), F.lit("medium"), F.lit("deep")), F.col("l_linenumber") % 3 + 1)
    hit = F.col("l_quantity").cast("int") % (F.col("l_linenumber") + 2) < 2
    line = table(spark, sf, "lineitem").select(
        F.when(F.col("l_returnflag") == "N", "gpt4o").otherwise("llama").alias("model"),
        F.lit("sentence_b").alias("sentence_col"),
        depth.alias("inferential_depth"),
        (F.col("l_tax") > 0.04).alias("is_critical_item"),
        F.when(hit, "It means the river bank.").otherwise("It means money.").alias("response"),
        F.lit("river bank").alias("ground_truth"),
        "l_returnflag",
        "l_linestatus",
    )
    responses = line.filter("l_linestatus = 'O' and l_returnflag <> 'A'").drop("l_returnflag", "l_linestatus")
    baseline = line.filter("l_returnflag = 'A'").drop("l_returnflag", "l_linestatus")
    found = experiments.accuracy_analysis(responses, baseline, ["gpt2_xl", "gpt4o", "llama"])["versus_baseline"]
    return rounded(found.select("system", "inferential_depth", "is_critical_item", "accuracy", "n", "gain"))


@query(
    "conformity_flow",
    f"""with {_SCORES} select 'c' || label as concept, case when label % 2 = 0 then 'charged' else 'control' end as concept_type, round(avg(conformity), 6) as conformity, count(*) as n
        from scored where vec_id % 3 = 0 and label <> 4 group by label order by 3 desc, 1""",
)
def conformity_flow(spark, sf):
    # One concept has no prototype and is named among the uncovered.
    vectors = table(spark, sf, "embeddings")
    protos = cf.centroids(vectors, ["label"], "embedding", "prototype").filter("label <> 4").withColumnRenamed("label", "concept_id")
    responses = vectors.select(
        "vec_id",
        F.col("label").alias("concept_id"),
        F.concat(F.lit("c"), "label").alias("concept"),
        F.when(F.col("label") % 2 == 0, "charged").otherwise("control").alias("concept_type"),
        F.element_at(F.array(F.lit(0.8), F.lit(0.2), F.lit(1.2)), (F.col("vec_id") % 3 + 1).cast("int")).alias("temperature"),
    )
    return rounded(experiments.conformity_analysis(responses, vectors.select("vec_id", "embedding"), protos, "vec_id")["ranking"])


@query(
    "trajectory_flow",
    f"""with {_SCORES}, u as (select vec_id % 4 + 1 as generation_ord, label, avg(conformity) as m from scored group by all)
        select generation_ord::int as generation_ord, case when label < 5 then 'changing' else 'stable' end as concept_type, round(avg(m), 6) as mean, count(*) as n_units
        from u group by 1, 2""",
)
def trajectory_flow(spark, sf):
    vectors = table(spark, sf, "embeddings")
    protos = cf.centroids(vectors, ["label"], "embedding", "prototype").withColumnRenamed("label", "concept")
    responses = vectors.select(
        "vec_id",
        F.col("label").alias("concept"),
        F.when(F.col("label") < 5, "changing").otherwise("stable").alias("concept_type"),
        F.concat(F.lit("gen"), F.col("vec_id") % 4 + 1).alias("generation"),
    )
    return rounded(experiments.diachronic_analysis(responses, vectors.select("vec_id", "embedding"), protos, "vec_id")["trajectory"])


@query(
    "effort_flow",
    """with e as (select min(l_extendedprice) a, max(l_extendedprice) b, min(l_linenumber) c, max(l_linenumber) d, min(l_suppkey) s, max(l_suppkey) t from lineitem),
        n as (select l_returnflag, (l_partkey % 5)::int as x, ((l_extendedprice - a) / (b - a + 1e-9) + (l_linenumber - c) / (d - c + 1e-9) + (l_suppkey - s) / (t - s + 1e-9))
                / (l_quantity + 1e-9) as y from lineitem, e)
       select l_returnflag, count(*) as n, round(regr_slope(y, x), 6) as slope, round(regr_intercept(y, x), 6) as intercept, round(avg(x), 6) as x_mean from n group by 1""",
)
def effort_flow(spark, sf):
    users = table(spark, sf, "lineitem").select(
        "l_returnflag",
        F.col("l_extendedprice").alias("time_on_task"),
        F.col("l_linenumber").alias("n_edits"),
        F.col("l_suppkey").alias("self_reported_difficulty"),
        F.col("l_quantity").alias("output_quality"),
        (F.col("l_partkey") % 5).cast("int").alias("education_level"),
        F.col("l_discount").alias("domain_familiarity"),
    )
    line = experiments.effort_analysis(users, ["l_returnflag"])["line"]
    return rounded(line.select("l_returnflag", "n", "slope", "intercept", "x_mean"))
