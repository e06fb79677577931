"""Lexical queries on the test tables.

The words of ``documents`` stand for a sense-tagged corpus: the language gives
the part of speech, the source the sense number. Every word of a user prompt in
``conversations`` that two more follow stands for a target word, those for its two
context words.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import lexical as ops
from ..operators import ranks
from ..session import kept
from .registry import query, rounded, table, texts

_WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{M}]+')"
_TOKENS = f"tok as materialized (select doc_id, lang, source, unnest({_WORDS}) as token from documents)"
_ZIPF = f"""{_TOKENS}, cnt as materialized (select token, count(*) as n from tok group by token),
    zipf as materialized (select token, round(log10(n / (select sum(n) from cnt)::double * 1e9), 2) as zipf from cnt)"""
_POS = "case lang when 'en' then 'n' when 'de' then 'v' when 'fr' then 'a' else 'r' end"
_SENSE = "lpad((substr(source, 4)::int % 3 + 1)::varchar, 2, '0')"
_TAGGED = f"""tagged as (select token as lemma, token || '.' || {_POS} || '.' || {_SENSE} as synset from tok),
    sc as materialized (select lemma, synset, count(*) as n, split_part(synset, '.', -2) as pos from tagged group by 1, 2),
    inv as (select distinct lemma, synset, split_part(synset, '.', -2) as pos, split_part(synset, '.', -1)::int as sense_rank from tagged)"""
_ITEMS = f"""w as (select conv_id, turn, {_WORDS} as w from conversations where role = 'user'),
    placed as (select *, unnest(range(1, len(w) - 1)) as i from w where len(w) >= 3),
    item as materialized (select conv_id || '-' || turn || '-' || i as item_id, w[i] as word, w[i] || '.n.02' as enc_synset, w[i] || '.n.01' as dict_synset,
                w[i + 1] as enc_ctx, w[i + 2] as dict_ctx, (len(w) + i) % 4 = 0 as in_manual,
                ['shallow', 'medium', 'deep'][(len(w) + i) % 3 + 1] as depth from placed)"""
_DOMINANT = """top as (select lemma, pos, sum(n) as total, arg_min(synset, (-n, synset)) as syn, max(n) as n from sc group by 1, 2),
    noun as (select lemma, arg_min(synset, (sense_rank, synset)) as syn from inv where pos = 'n' group by 1),
    any_pos as (select lemma, arg_min(synset, (sense_rank, synset)) as syn from inv group by 1),
    d as (select i.*, coalesce(t.syn, noun.syn, any_pos.syn, 'UNKNOWN') as dominant,
            case when t.syn is not null then 'semcor' when any_pos.syn is not null then 'wordnet_ordering' else 'none' end as sense_source,
            coalesce(t.n, 0) as sense_n
          from item i left join top t on t.lemma = i.word and t.pos = 'n' and t.total >= 5
            left join noun on noun.lemma = i.word left join any_pos on any_pos.lemma = i.word)"""


def _tagged(spark, sf):
    docs = texts(spark, sf)
    pos = (
        F.when(F.col("lang") == "en", "n").when(F.col("lang") == "de", "v").when(F.col("lang") == "fr", "a").otherwise("r")
    )
    number = F.lpad((F.substring("source", 4, 9).cast("int") % 3 + 1).cast("string"), 2, "0")
    return ops.tokens(docs, "text", "lang", "source").select(
        F.col("token").alias("lemma"), F.concat_ws(".", "token", pos, number).alias("synset")
    )


def _inventory(tagged):
    """Senses with their numbers; of a counted table every row is one."""
    rows = tagged if "n" in tagged.columns else tagged.distinct()
    return rows.withColumn("sense_rank", F.element_at(F.split("synset", r"\."), -1).cast("int"))


def _items(spark, sf):
    prompts = table(spark, sf, "conversations").filter(F.col("role") == "user")
    w = prompts.select("conv_id", "turn", tx.words("text").alias("w")).filter(F.size("w") >= 3)
    at = w.select("*", F.explode(F.sequence(F.lit(1), F.size("w") - 2)).alias("i"))
    number = F.size("w") + F.col("i")
    depth = F.element_at(F.array(F.lit("shallow"), F.lit("medium"), F.lit("deep")), number % 3 + 1)
    word = F.element_at("w", F.col("i"))
    return at.select(
        F.concat_ws("-", "conv_id", "turn", "i").alias("item_id"),
        word.alias("word"),
        F.concat(word, F.lit(".n.02")).alias("enc_synset"),
        F.concat(word, F.lit(".n.01")).alias("dict_synset"),
        F.element_at("w", F.col("i") + 1).alias("enc_ctx"),
        F.element_at("w", F.col("i") + 2).alias("dict_ctx"),
        (number % 4 == 0).alias("in_manual"),
        depth.alias("depth"),
    )


def _counted(spark, sf, items, *columns):
    """Sense counts of the words that items name, written down so that all uses know how few they are."""
    return kept(ops.only_words(ops.sense_counts(_tagged(spark, sf), expand_lemmas=False), "lemma", items, *columns), "senses")


def _judged(items, counts):
    return ops.dominant_sense(items, counts, _inventory(counts), "word", "pos")


def _with_dominant(spark, sf):
    items = _items(spark, sf).withColumn("pos", tx.part_of_speech("enc_synset"))
    return _judged(items, _counted(spark, sf, items, "word"))


def _tiers(spark, sf):
    items = _items(spark, sf).withColumn("pos", tx.part_of_speech("enc_synset"))
    counts = _counted(spark, sf, items, "word", "enc_ctx", "dict_ctx")
    seen = counts.groupBy(F.col("lemma").alias("token")).agg(F.sum("n").alias("n"))
    zipf = ops.zipf_table(seen, ops.corpus_size(texts(spark, sf), "text").scalar())
    senses = _judged(items, counts)
    looked_up = ops.with_zipf(ops.with_zipf(senses, zipf, "enc_ctx", "zipf_enc"), zipf, "dict_ctx", "zipf_dict")
    return ops.critical_tiers(looked_up)


@query("zipf", f"with {_ZIPF} select token, zipf from zipf")
def zipf(spark, sf):
    return ops.zipf_table(ops.token_counts(texts(spark, sf), "text"))


@query(
    "phrase_zipf",
    f"""with {_ZIPF}, p as (select conv_id, turn, text as phrase from conversations),
        w as (select phrase, unnest(regexp_extract_all(lower(phrase), '[\\p{{L}}\\p{{M}}]+')) as token from (select distinct phrase from p)),
        f as (select phrase, case when count(*) filter (n is null) = 0 then round(log10(1e9 / sum(1 / (n / (select sum(n) from cnt)))), 2) else 0 end::double as zipf
              from w left join cnt using (token) group by 1)
        select conv_id, turn, phrase, zipf from p left join f using (phrase)""",
)
def phrase_zipf(spark, sf):
    phrases = table(spark, sf, "conversations").select("conv_id", "turn", F.col("text").alias("phrase"))
    counts = kept(ops.token_counts(texts(spark, sf), "text"), "words")
    return ops.with_phrase_zipf(phrases, counts, "phrase", "zipf").select("conv_id", "turn", "phrase", "zipf")


@query("sense_counts", f"with {_TOKENS}, {_TAGGED} select lemma, synset, n from sc")
def sense_counts(spark, sf):
    return ops.sense_counts(_tagged(spark, sf), expand_lemmas=False)


@query(
    "sense_counts_expanded",
    f"""with {_TOKENS}, {_TAGGED},
        g as (select split_part(synset, '.', -2) || '.' || length(lemma) as synset, lemma from tagged),
        m as (select distinct synset, lemma from g), c as (select synset, count(*) as n from g group by 1)
        select lemma, synset, n from m join c using (synset)""",
)
def sense_counts_expanded(spark, sf):
    # Words with the same part of speech and length stand for the lemmas of one synset.
    coarse = _tagged(spark, sf).select(
        F.concat_ws(".", tx.part_of_speech("synset"), F.length("lemma").cast("string")).alias("synset"), "lemma"
    )
    return ops.sense_counts(coarse, coarse)


@query(
    "synsets_per_word", f"with {_TOKENS}, {_TAGGED} select lemma, count(distinct synset) as n_synsets from inv group by 1"
)
def synsets_per_word(spark, sf):
    return ops.synsets_per_word(_inventory(_tagged(spark, sf)))


@query(
    "dominant_sense",
    f"""with {_TOKENS}, {_TAGGED}, {_ITEMS}, {_DOMINANT}
        select item_id, word, dominant, sense_source, sense_n from d""",
)
def dominant_sense(spark, sf):
    return _with_dominant(spark, sf).select("item_id", "word", "dominant", "sense_source", "sense_n")


_TIERED = f"""{_ZIPF}, {_TAGGED}, {_ITEMS}, {_DOMINANT},
    z as (select d.*, coalesce(a.zipf, 0.0) as zipf_enc, coalesce(b.zipf, 0.0) as zipf_dict
          from d left join zipf a on a.token = d.enc_ctx left join zipf b on b.token = d.dict_ctx),
    t as (select *, enc_synset <> dict_synset and dominant <> enc_synset as sense_mismatch, zipf_enc < zipf_dict as freq_lower from z),
    tiers as (select *, case when sense_mismatch and freq_lower then 'T1_auto' when sense_mismatch then 'T2_auto'
                             when in_manual then 'T3_manual' else '-' end as tier from t)"""


@query(
    "critical_tiers",
    f"""with {_TIERED}
        select item_id, dominant, zipf_enc, zipf_dict, sense_mismatch, freq_lower, tier, tier <> '-' as is_critical_item,
           sense_source || '(n=' || sense_n || ')' || case when in_manual then '+manual' else '' end as verification_source
        from tiers""",
)
def critical_tiers(spark, sf):
    return _tiers(spark, sf).select(
        "item_id",
        "dominant",
        "zipf_enc",
        "zipf_dict",
        "sense_mismatch",
        "freq_lower",
        "tier",
        "is_critical_item",
        ops.verification_source().alias("verification_source"),
    )


@query(
    "critical_summary",
    f"""with {_TIERED}
        select depth, count(*) as n_items, count(*) filter (tier <> '-') as n_critical, count(*) filter (tier = 'T1_auto') as n_t1,
          count(*) filter (tier = 'T2_auto') as n_t2, count(*) filter (tier = 'T3_manual') as n_t3
        from tiers group by rollup (depth)""",
)
def critical_summary(spark, sf):
    return ops.tier_summary(_tiers(spark, sf), "depth")


@query(
    "tier_rollup",
    """with t as (select o_orderpriority, case when o_orderstatus = 'F' and o_totalprice < 150000 then 'T1_auto'
                     when o_orderstatus = 'F' then 'T2_auto' when o_totalprice > 400000 then 'T3_manual' else '-' end as tier from orders)
       select o_orderpriority, count(*) as n_items, count(*) filter (tier <> '-') as n_critical, count(*) filter (tier = 'T1_auto') as n_t1,
         count(*) filter (tier = 'T2_auto') as n_t2, count(*) filter (tier = 'T3_manual') as n_t3
       from t group by rollup (o_orderpriority)""",
)
def tier_rollup(spark, sf):
    mismatch, lower = F.col("o_orderstatus") == "F", F.col("o_totalprice") < 150000
    tiered = table(spark, sf, "orders").withColumn("tier", ops.tier(mismatch, lower, F.col("o_totalprice") > 400000))
    return ops.tier_summary(tiered, "o_orderpriority")


@query(
    "annotate_items",
    """select p_partkey, p_name, coalesce(s_name, 'UNKNOWN') as s_name,
          p_size in (select l_linenumber from lineitem) as in_manual
       from part left join supplier on p_partkey = s_suppkey""",
)
def annotate_items(spark, sf):
    parts = table(spark, sf, "part").select("p_partkey", "p_name", "p_size")
    meta = table(spark, sf, "supplier").withColumnRenamed("s_suppkey", "p_partkey")
    annotated = ops.annotate_items(parts, meta, "p_partkey", {"s_name": ops.UNKNOWN})
    numbers = table(spark, sf, "lineitem").select(F.col("l_linenumber").alias("p_size"))
    return ops.mark_members(annotated, numbers, "p_size", "in_manual").drop("p_size")


@query(
    "membership",
    """select o_orderkey, exists (from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R' and l_quantity > 45) as in_manual,
          o_orderstatus || case when exists (from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R' and l_quantity > 45)
             then '+manual' else '' end as verification_source from orders""",
)
def membership(spark, sf):
    listed = table(spark, sf, "lineitem").filter((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 45))
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    marked = ops.mark_members(orders, listed.select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "in_manual")
    suffix = F.when(F.col("in_manual"), "+manual").otherwise("")
    return marked.select("o_orderkey", "in_manual", F.concat("o_orderstatus", suffix).alias("verification_source"))


@query(
    "update_columns",
    """select c_custkey, c_name, top_price, n_orders from customer left join
         (select o_custkey, max(o_totalprice) as top_price, count(*) as n_orders from orders group by 1) on o_custkey = c_custkey""",
)
def update_columns(spark, sf):
    analysis = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.max("o_totalprice").alias("top_price"), F.count(F.lit(1)).alias("n_orders")
    )
    draft = table(spark, sf, "customer").select("c_custkey", "c_name", F.lit(None).cast("double").alias("top_price"))
    return ops.update_columns(draft, analysis, "c_custkey", ["top_price", "n_orders"])


@query(
    "item_ids",
    """select p_partkey, 'E4_' || lpad(rn::varchar, greatest(3, length(rn::varchar))::int, '0') as item_id
       from (select p_partkey, row_number() over (order by p_type, p_partkey) as rn from part)""",
)
def item_ids(spark, sf):
    parts = table(spark, sf, "part").select("p_partkey", "p_type")
    return ranks.item_ids(parts, F.col("p_type"), "p_partkey", "E4").select("p_partkey", "item_id")


@query(
    "tier_threshold",
    """with z as (select p_partkey, case p_type when 'PROMO' then 'shallow' when 'SMALL' then 'medium' else 'deep' end as depth,
                  p_size / 10.0::double as zipf from part),
         t as (select *, case depth when 'shallow' then 3.5 when 'medium' then 3.2 else 2.8 end::double as threshold from z)
       select * from t where zipf < threshold""",
)
def tier_threshold(spark, sf):
    depth = F.when(F.col("p_type") == "PROMO", "shallow").when(F.col("p_type") == "SMALL", "medium").otherwise("deep")
    items = table(spark, sf, "part").select("p_partkey", depth.alias("depth"), (F.col("p_size") / 10).alias("zipf"))
    return ops.below_threshold(items, "depth", "zipf", ops.DEPTH_THRESHOLDS)


@query(
    "band_check",
    """with b as (select p_partkey, case p_type when 'PROMO' then 'high' when 'SMALL' then 'medium' else 'near_monosemous' end as band,
                  p_size % 7 as n_synsets, p_size / 10.0::double as zipf from part)
       select *, n_synsets < case band when 'high' then 4 when 'medium' then 2 else 1 end as below_band,
          n_synsets > case band when 'high' then 99 when 'medium' then 3 else 2 end as above_band,
          not (zipf between 3.5 and 6.5) as zipf_outside from b""",
)
def band_check(spark, sf):
    band = F.when(F.col("p_type") == "PROMO", "high").when(F.col("p_type") == "SMALL", "medium").otherwise("near_monosemous")
    items = table(spark, sf, "part").select(
        "p_partkey", band.alias("band"), (F.col("p_size") % 7).alias("n_synsets"), (F.col("p_size") / 10).alias("zipf")
    )
    return ops.band_flags(items, "band", "n_synsets", "zipf", ops.BAND_SYNSETS, ops.TERM_ZIPF)


@query(
    "contrast_check",
    rf"""with {_ZIPF}, c as (select conv_id, turn, string_split_regex(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+')[1] as contrast_word
                             from conversations where length(trim(text)) > 0)
        select conv_id, turn, contrast_word, coalesce(zipf, 0.0) as contrast_zipf, coalesce(zipf, 0.0) < 4.0 as contrast_low
        from c left join zipf on token = lower(contrast_word)""",
)
def contrast_check(spark, sf):
    zipf = ops.zipf_table(ops.token_counts(texts(spark, sf), "text"))
    phrases = table(spark, sf, "conversations").filter(tx.non_blank("text"))
    return ops.contrast_check(phrases, zipf, "text").select("conv_id", "turn", "contrast_word", "contrast_zipf", "contrast_low")


@query(
    "concept_docs",
    f"""with {_TOKENS}, {_ITEMS}, c as (select distinct word as lemma from item),
        h as (select distinct lemma as concept_id, doc_id from tok join c on token = lemma)
        select concept_id, doc_id, rank::int as rank from (select *, row_number() over (partition by concept_id order by doc_id) as rank from h)
        where rank <= 100""",
)
def concept_docs(spark, sf):
    concepts = _items(spark, sf).select(F.col("word").alias("concept_id"), F.col("word").alias("lemma")).distinct()
    return ops.concept_documents(texts(spark, sf), concepts, "doc_id", "text").select("concept_id", "doc_id", "rank")


_PAIRS = f"""ws as materialized (select {_WORDS} as w from documents),
    tk as (select unnest(list_zip(w, w[2:], w[3:])) as z from ws),
    nx as (select z[1] as x, z[2] as y from tk union all select z[1], z[3] from tk),
    pr as (select least(x, y) as word_a, greatest(x, y) as word_b from nx where x is not null and y is not null),
    pairs as materialized (select word_a, word_b, count(*) as n from pr group by 1, 2)"""


@query("cooccur", f"with {_PAIRS} select word_a, word_b, n from pairs")
def cooccur(spark, sf):
    return ops.cooccurrence(texts(spark, sf), "text", 2)


@query(
    "cooccur_baseline",
    f"""with {_PAIRS}, {_ITEMS},
        j as (select item_id, coalesce(a.n, 0) as n_enc, coalesce(b.n, 0) as n_dict from item
              left join pairs a on a.word_a = least(word, enc_ctx) and a.word_b = greatest(word, enc_ctx)
              left join pairs b on b.word_a = least(word, dict_ctx) and b.word_b = greatest(word, dict_ctx))
        select *, case when n_enc > n_dict then 'encyclopedic' else 'dictionary' end as predicted from j""",
)
def cooccur_baseline(spark, sf):
    items = _items(spark, sf)
    asked = kept(ops.asked_pairs(items, "word", "enc_ctx", "dict_ctx"), "asked")
    pairs = kept(ops.cooccurrence(texts(spark, sf), "text", 2, asked), "pairs")
    out = ops.cooccurrence_baseline(items, pairs, "word", "enc_ctx", "dict_ctx")
    return out.select("item_id", "n_enc", "n_dict", "predicted")


@query(
    "dictionary_baseline",
    f"""with {_TOKENS}, {_TAGGED}, {_ITEMS}, {_DOMINANT}
        select item_id, case when dominant = enc_synset then 'encyclopedic' else 'dictionary' end as predicted from d""",
)
def dictionary_baseline(spark, sf):
    return ops.dictionary_baseline(_with_dominant(spark, sf)).select("item_id", "predicted")


@query(
    "classify",
    f"""with a as (select conv_id, turn, text, lag(text) over (partition by conv_id order by turn) as prompt, role from conversations),
        t as (select distinct conv_id, turn, text, unnest({_WORDS.replace('text', 'prompt')}) as truth from a where role = 'assistant')
       select conv_id, turn, truth, case when contains(lower(text), truth) then 'encyclopedic' when text is not null then 'neither' end as label from t""",
)
def classify(spark, sf):
    # Every word of the turn before a response is a ground truth.
    turns = table(spark, sf, "conversations")
    truth = F.explode(F.array_distinct(tx.words("text"))).alias("truth")
    before = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), truth)
    answers = turns.filter(F.col("role") == "assistant").join(before, ["conv_id", "turn"])
    return answers.select("conv_id", "turn", "truth", tx.reading_label("text", "truth").alias("label"))


@query(
    "classify_passages",
    "select doc_id, item_id from documents d, benchmark b where contains(lower(d.text), lower(b.text))",
)
def classify_passages(spark, sf):
    return ops.containing_passages(
        texts(spark, sf), table(spark, sf, "benchmark").withColumnRenamed("text", "passage"), "doc_id", "text", "item_id", "passage"
    )


@query(
    "short_passages",
    r"""with p as (select distinct array_to_string(regexp_extract_all(text, '\S+')[1:1 + item_id % 6], ' ') as passage from benchmark
                   union select '-' union select '42')
       select doc_id, passage from documents d, p where contains(lower(d.text), lower(passage))""",
)
def short_passages(spark, sf):
    # Openings of one to six words, a sign and a number: passages that have few inner words, or none.
    opening = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0)), F.lit(1), (F.col("item_id") % 6 + 1).cast("int")), " ")
    signs = spark.createDataFrame([("-",), ("42",)], "passage string")
    passages = table(spark, sf, "benchmark").select(opening.alias("passage")).union(signs).distinct()
    passages = passages.withColumn("name", F.col("passage"))
    found = ops.containing_passages(texts(spark, sf), passages, "doc_id", "text", "name", "passage")
    return found.select("doc_id", F.col("name").alias("passage"))


@query(
    "readability",
    rf"""with w as (select doc_id, text, {_WORDS} as w from documents),
        c as (select doc_id, len(w) as n, len(list_distinct(w)) as k, greatest(len(regexp_extract_all(text, '[.!?]+')), 1) as s,
                len(regexp_extract_all(lower(text), '[aeiouyáàâäéèêëíîïóôöúûüœæ]+')) as y from w)
        select doc_id, case when n > 0 then round(k / n, 6) end as ttr, case when n > 0 then round(0.39 * n / s + 11.8 * y / n - 15.59, 6) end as grade from c""",
)
def readability(spark, sf):
    return rounded(ops.readability(texts(spark, sf), "text", "doc_id"))


@query(
    "markers",
    f"""with {_TOKENS}, lex(token, category) as (values ('the', 'article'), ('le', 'article'), ('la', 'article'), ('der', 'article'),
              ('he', 'gender'), ('she', 'gender'), ('elle', 'gender'), ('er', 'gender'))
        select source, category, count(*) as n_markers, count(distinct doc_id) as n_documents from tok join lex using (token) group by all""",
)
def markers(spark, sf):
    lexicon = {"article": ["the", "le", "la", "der"], "gender": ["he", "she", "elle", "er"]}
    rows = [(word, category) for category, listed in lexicon.items() for word in listed]
    return ops.marker_counts(
        texts(spark, sf), spark.createDataFrame(rows, "token string, category string"), "text", "source"
    )
