"""Design, reshaping and filter queries on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import design as ops
from .registry import query, rounded, table

_PROBE = "Text: {sentence}\nSay briefly which meaning '{target}' has there."


@query(
    "unpivot_part",
    """with v as (select p_partkey, unnest(['neutral', 'explicit_a', 'paraphrase_a']) as prompt_key,
                      unnest([p_name, case when p_size % 3 = 0 then '  ' else p_brand end, p_type]) as prompt from part)
       select p_partkey, prompt_key, prompt, starts_with(prompt_key, 'paraphrase') as is_paraphrase
       from v where length(trim(prompt)) > 0""",
)
def unpivot_part(spark, sf):
    parts = table(spark, sf, "part").withColumn("brand", F.when(F.col("p_size") % 3 == 0, "  ").otherwise(F.col("p_brand")))
    variants = {"neutral": "p_name", "explicit_a": "brand", "paraphrase_a": "p_type"}
    return ops.unpivot_prompts(parts, ["p_partkey"], variants)


@query(
    "unpivot_pairs",
    """select o_orderkey, 'sentence_a' as sentence_col, o_orderstatus as sentence, null::varchar as ground_truth from orders
       union all select o_orderkey, 'sentence_b', o_orderpriority, o_orderstatus from orders""",
)
def unpivot_pairs(spark, sf):
    sides = {"sentence_a": ("o_orderstatus", None), "sentence_b": ("o_orderpriority", "o_orderstatus")}
    return ops.unpivot_sides(table(spark, sf, "orders"), ["o_orderkey"], sides)


@query(
    "render_prompt",
    """select p_partkey,
          'Text: {target} ' || p_type || chr(10) || 'Say briefly which meaning ''' || p_name || ''' has there.' as prompt,
          'Rate {"score": <int>} for ' || p_brand as judge_prompt,
          'passage: ' || p_type as embed_text
       from part""",
)
def render_prompt(spark, sf):
    # The sentence holds a brace of its own, and the judge template holds literal JSON braces.
    parts = table(spark, sf, "part").withColumn("sentence", F.concat(F.lit("{target} "), "p_type"))
    return parts.select(
        "p_partkey",
        tx.render(_PROBE, target="p_name", sentence="sentence").alias("prompt"),
        tx.render('Rate {"score": <int>} for {domain}', domain="p_brand").alias("judge_prompt"),
        tx.embed_input("p_type").alias("embed_text"),
    )


@query(
    "design_grid",
    """select s_suppkey, model, temperature, response_index,
          model || '_T' || replace(temperature::varchar, '.', '') as tag,
          case when temperature = 0.0 then 'T0' else 'T07' end as two_way_tag
       from supplier, (select unnest(['gpt4o', 'llama', 'mistral']) as model),
            (select unnest([0.2, 0.5, 0.8, 1.2]::double[]) as temperature),
            (select unnest(range(10))::int as response_index)""",
)
def design_grid(spark, sf):
    stimuli = table(spark, sf, "supplier").select("s_suppkey")
    grid = ops.design_grid(stimuli, 10, ops.TEMPERATURES["E2"], ["gpt4o", "llama", "mistral"])
    return grid.select(
        "*", tx.slice_tag("model", "temperature").alias("tag"), tx.two_way_tag("temperature").alias("two_way_tag")
    )


@query(
    "factorial16",
    """select c_custkey, i::int as condition, (i & 1) = 1 as "D", (i >> 1 & 1) = 1 as "R", (i >> 2 & 1) = 1 as "V",
          (i >> 3 & 1) = 1 as "C",
          case when (i & 1) = 1 then 'D' else '~D' end || case when (i >> 1 & 1) = 1 then 'R' else '~R' end
            || case when (i >> 2 & 1) = 1 then 'V' else '~V' end || case when (i >> 3 & 1) = 1 then 'C' else '~C' end as condition_id,
          bit_count(i::int)::int as n_components
       from customer, (select unnest(range(16)) as i)""",
)
def factorial16(spark, sf):
    return ops.factorial_conditions(table(spark, sf, "customer").select("c_custkey"))


_DOMAIN_LIST = ", ".join(f"'{d}'" for d in ops.DOMAIN_COMPLEXITY)
_HIGH_LIST = ", ".join(f"'{d}'" for d, c in ops.DOMAIN_COMPLEXITY.items() if c == "high")
_FOCAL_LIST = ", ".join(f"'{d}'" for d in ops.FOCAL_DOMAINS)


@query(
    "canonical_levels",
    f"""with c as (select c_custkey, [{_DOMAIN_LIST}][c_custkey % 10 + 1] as domain from customer)
        select c_custkey, domain, case when domain in ({_HIGH_LIST}) then 'high' else 'standard' end as complexity,
           domain in ({_FOCAL_LIST}) as is_focal, l::int as level, l >= 1 as "D", l >= 2 as "R", l >= 2 as "V", l >= 3 as "C",
           'L' || l as condition_id
        from c, (select unnest(range(4)) as l)""",
)
def canonical_levels(spark, sf):
    names = F.array(*[F.lit(d) for d in ops.DOMAIN_COMPLEXITY])
    tasks = table(spark, sf, "customer").select(
        "c_custkey", F.element_at(names, (F.col("c_custkey") % 10 + 1).cast("int")).alias("domain")
    )
    return ops.canonical_levels(ops.with_domain(tasks))


@query(
    "prompt_hash",
    """select conv_id, turn, substr(md5(text), 1, 8) as prompt_hash,
          'chat-' || conv_id % 3 || '_' || substr(md5(text || 'org/chat-' || conv_id % 3 || '0.7' || turn), 1, 8) || '_' || turn as call_id
       from conversations where role = 'user'""",
)
def prompt_hash(spark, sf):
    prompts = table(spark, sf, "conversations").filter(F.col("role") == "user")
    model = F.concat(F.lit("org/chat-"), (F.col("conv_id") % 3).cast("string"))
    return prompts.select(
        "conv_id",
        "turn",
        tx.prompt_hash("text").alias("prompt_hash"),
        tx.call_id("text", model, F.lit(0.7), "turn").alias("call_id"),
    )


@query(
    "ordinal_map",
    """select o_orderkey, case o_orderpriority when '1-URGENT' then 1 when '2-HIGH' then 2 when '3-MEDIUM' then 3 else 2 end as depth,
          case o_orderpriority when '1-URGENT' then 1 when '2-HIGH' then 2 when '3-MEDIUM' then 3 end as strict_depth,
          (o_orderstatus = 'F')::int as is_final
       from orders""",
)
def ordinal_map(spark, sf):
    codes = {"1-URGENT": 1, "2-HIGH": 2, "3-MEDIUM": 3}
    return table(spark, sf, "orders").select(
        "o_orderkey",
        ops.ordinal("o_orderpriority", codes, default=2).alias("depth"),
        ops.ordinal("o_orderpriority", codes).alias("strict_depth"),
        ops.flag(F.col("o_orderstatus") == "F").alias("is_final"),
    )


@query(
    "row_mean",
    """select l_orderkey, l_linenumber, l_partkey, l_suppkey,
          round(list_avg([l_quantity, nullif(l_discount, 0.05), nullif(l_tax, 0.0)]), 6) as quality from lineitem""",
)
def row_mean(spark, sf):
    df = table(spark, sf, "lineitem")
    quality = ops.row_mean("l_quantity", F.nullif("l_discount", F.lit(0.05)), F.nullif("l_tax", F.lit(0.0)))
    return rounded(df.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", quality.alias("quality")))


@query(
    "judge_route",
    """select o_orderkey, o_orderstatus as model, case o_orderstatus when 'O' then 'P' else 'O' end as judge_model
       from orders where o_orderstatus in ('O', 'P', 'F')""",
)
def judge_route(spark, sf):
    responses = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("model"))
    return ops.route_judges(responses, {"O": "P", "P": "O", "F": "O"})


@query(
    "pending_work",
    "select o_orderkey, o_custkey from orders where not exists (from lineitem where l_orderkey = o_orderkey)",
)
def pending_work(spark, sf):
    design = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    done = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return ops.pending(design, done, ["o_orderkey"])


@query(
    "coverage_gap",
    """select c_custkey, count(*) as n_rows from customer
       where not exists (from orders where o_custkey = c_custkey and o_orderstatus = 'F') group by 1""",
)
def coverage_gap(spark, sf):
    customers = table(spark, sf, "customer").select("c_custkey")
    final = table(spark, sf, "orders").filter(F.col("o_orderstatus") == "F")
    return ops.coverage_gap(customers, final.select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query(
    "nonblank",
    r"""select doc_id, length(s) as n_chars
        from (select doc_id, regexp_replace(text, '^[\s\x{0B}\x{85}\x{A0}\x{2000}-\x{200A}\x{3000}]+|[\s\x{0B}\x{85}\x{A0}\x{2000}-\x{200A}\x{3000}]+$', '', 'g') as s from documents)
        where length(s) > 0""",
)
def nonblank(spark, sf):
    docs = table(spark, sf, "documents").filter(tx.non_blank("text"))
    return docs.select("doc_id", F.length(tx.strip("text")).cast("bigint").alias("n_chars"))


@query(
    "head_controls",
    """select * from (select s_name as concept, 'stable' as concept_type from supplier where s_acctbal < 5000
                      order by s_suppkey limit 10)
       union all select s_name, 'changing' from supplier where s_acctbal >= 5000""",
)
def head_controls(spark, sf):
    suppliers = table(spark, sf, "supplier")
    controls = ops.head_by(suppliers.filter(F.col("s_acctbal") < 5000), ["s_suppkey"], 10)
    stable = controls.select(F.col("s_name").alias("concept"), F.lit("stable").alias("concept_type"))
    changing = suppliers.filter(F.col("s_acctbal") >= 5000)
    return stable.unionByName(changing.select(F.col("s_name").alias("concept"), F.lit("changing").alias("concept_type")))
