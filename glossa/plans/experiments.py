"""End-to-end analyses, from stored records to result tables.

Each returns named DataFrames. Nothing runs until they are used, except that the
binomial and the mixed model fit when they are built.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import conformity as cf
from ..operators import design, lexical, models, silhouette
from ..operators import summaries as sm
from ..sources import files
from ..sources.schemas import JUDGE_REPLY, SCORE_FIELDS, TERM_COLUMNS, TERM_PROMPTS


# Fixed value: how the prompt library names the texts of a domain.
DOMAIN_PART = "example_domain_"

# --- request tables ---------------------------------------------------------


def term_requests(terms: DataFrame, models_: Sequence[str]) -> DataFrame:
    """E1: every non-blank prompt variant of every term, per model and replicate."""
    renamed = terms.withColumnsRenamed(TERM_COLUMNS)
    long = design.unpivot_prompts(renamed, list(TERM_COLUMNS.values()), TERM_PROMPTS)
    return design.design_grid(long, design.REPLICATES["E1"], design.TEMPERATURES["E1"], models_)


def concept_requests(concepts: DataFrame, template: str, models_: Sequence[str]) -> DataFrame:
    """E2: one prompt per concept, per model, temperature and replicate."""
    prompted = concepts.select("concept_id", "concept", "concept_type", tx.render(template, concept="concept").alias("prompt"))
    return design.design_grid(prompted, design.REPLICATES["E2"], design.TEMPERATURES["E2"], models_)


def pair_requests(pairs: DataFrame, template: str, models_: Sequence[str]) -> DataFrame:
    """E4: both sentences of every pair; only the second has a ground truth."""
    sides = {"sentence_a": ("sentence_a", None), "sentence_b": ("sentence_b", "ground_truth_reading")}
    ids = ["item_id", "target_word", "inferential_depth", "is_critical_item"]
    long = design.unpivot_sides(pairs, ids, sides)
    prompted = long.withColumn("prompt", tx.render(template, target="target_word", sentence="sentence")).drop("sentence")
    return design.design_grid(prompted, design.REPLICATES["E4"], design.TEMPERATURES["E4"], models_)


def generation_requests(
    concepts: DataFrame, template: str, generations: Mapping[str, str] = design.GENERATION_MODELS
) -> DataFrame:
    """E5: changing and stable concepts over the model generations, each with the model that stands for it."""
    chosen = design.diachronic_concepts(concepts).withColumn("prompt", tx.render(template, concept="concept"))
    pairs = F.array(*[F.struct(F.lit(g).alias("generation"), F.lit(m).alias("model")) for g, m in generations.items()])
    return design.design_grid(chosen.select("*", F.inline(pairs)), design.REPLICATES["E5"], design.TEMPERATURES["E5"])


def domain_texts(prompts: DataFrame) -> DataFrame:
    """(domain, texts) of a prompt library: texts by name, levels ``L0``…``L3`` and components ``D``, ``R``, ``V``, ``C``."""
    own = prompts.filter((F.col("experiment") == "exp3") & F.startswith("part", F.lit(DOMAIN_PART)))
    named = own.groupBy(F.substring("part", len(DOMAIN_PART) + 1, 1 << 30).alias("domain"), "name").agg(F.min("text").alias("text"))
    return named.groupBy("domain").agg(F.map_from_entries(F.collect_list(F.struct("name", "text"))).alias("texts"))


def domains_without_prompts(domains: DataFrame, prompts: DataFrame) -> DataFrame:
    return design.coverage_gap(domains, domain_texts(prompts), ["domain"])


def domain_requests(domains: DataFrame, models_: Sequence[str], prompts: DataFrame | None = None) -> DataFrame:
    """E3: the 2^4 conditions of focal domains and the four canonical levels of all others.

    A focal condition that is one of the canonical levels carries it, so that focal domains enter the analyses by level.
    With a prompt library every row has its ``prompt``: the text of its level, else the request of level 0 with the texts
    of the components present, the role before it. Conditions whose texts are not all in the library are left out;
    ``domains_without_prompts`` names the domains that have none.
    """
    known = design.with_domain(domains)
    full = design.factorial_conditions(known.filter("is_focal")).drop("condition").withColumn("level", design.canonical_level())
    canonical = design.canonical_levels(known.filter("not is_focal"))
    counted = sum((F.col(c).cast("int") for c in design.COMPONENTS[1:]), F.col(design.COMPONENTS[0]).cast("int"))
    conditions = full.unionByName(canonical.withColumn("n_components", counted))
    if prompts is not None:
        text = lambda name: F.try_element_at("_texts", F.lit(name))
        level = F.try_element_at("_texts", F.concat(F.lit("L"), F.col("level").cast("string")))
        part = lambda c: F.when(F.col(c), F.concat(text(c), F.lit(" "))).otherwise("")
        composed = F.rtrim(F.concat(part("R"), text("L0"), F.lit(" "), part("D"), part("V"), part("C")))
        conditions = conditions.join(domain_texts(prompts).withColumnRenamed("texts", "_texts"), "domain")
        conditions = conditions.withColumn("prompt", F.coalesce(level, composed)).drop("_texts").filter(tx.non_blank("prompt"))
    return design.design_grid(conditions, design.REPLICATES["E3"], (), models_)


def judge_requests(responses: DataFrame, ground_truth: DataFrame, template: str, routes: dict[str, str]) -> DataFrame:
    """Judge prompts of all responses whose domain has a ground truth, each with its judge."""
    joined = design.route_judges(responses, routes).join(ground_truth, "domain")
    prompt = tx.render(template, domain="domain", ground_truth="ground_truth", response="response")
    return joined.withColumn("judge_prompt", prompt).drop("ground_truth")


# --- analyses ---------------------------------------------------------------


def critical_items(
    draft: DataFrame, meta: DataFrame, manual: DataFrame, counts: DataFrame, inventory: DataFrame, zipf: DataFrame
) -> dict[str, DataFrame]:
    """Tier every draft item; returns the analysis, its summary by depth and the locked stimuli.

    ``meta`` has item_id, enc_synset, dict_synset, enc_ctx, dict_ctx; ``manual`` has
    item_id and manual_rationale.
    """
    defaults = {"enc_synset": lexical.UNKNOWN, "dict_synset": lexical.UNKNOWN, "enc_ctx": "", "dict_ctx": ""}
    items = draft.select("item_id", "target_word", "inferential_depth")
    items = lexical.annotate_items(items, meta, "item_id", defaults)
    items = lexical.mark_members(items, manual, "item_id", "in_manual")
    items = items.join(manual, "item_id", "left").withColumn("manual_rationale", F.coalesce("manual_rationale", F.lit("")))
    items = items.withColumn("pos", tx.part_of_speech("enc_synset"))
    counts, inventory = (lexical.only_words(known, "lemma", items, "target_word") for known in (counts, inventory))
    items = lexical.dominant_sense(items, counts, inventory, "target_word", "pos")
    items = lexical.with_zipf(items, zipf, "enc_ctx", "zipf_enc")
    items = lexical.with_zipf(items, zipf, "dict_ctx", "zipf_dict")
    tiers = lexical.critical_tiers(items)
    analysis = tiers.select(
        "item_id",
        "target_word",
        "inferential_depth",
        F.col("dominant").alias("corpus_dominant_sense"),
        lexical.verification_source().alias("verification_source"),
        F.col("enc_synset").alias("encyclopedic_target_sense"),
        "dict_synset",
        F.col("enc_ctx").alias("enc_ctx_word"),
        F.col("dict_ctx").alias("dict_ctx_word"),
        F.col("zipf_enc").alias("zipf_enc_ctx"),
        F.col("zipf_dict").alias("zipf_dict_ctx"),
        "sense_mismatch",
        "freq_lower",
        "tier",
        "is_critical_item",
        "manual_rationale",
    )
    written = ["corpus_dominant_sense", "verification_source", "encyclopedic_target_sense", "is_critical_item"]
    return {
        "analysis": analysis,
        "summary": lexical.tier_summary(analysis, "inferential_depth"),
        "listing": lexical.critical_listing(analysis, "inferential_depth", "item_id"),
        "locked": lexical.update_columns(draft, analysis, "item_id", written),
    }


def accuracy_analysis(responses: DataFrame, baseline: DataFrame, systems: Sequence[str]) -> dict[str, DataFrame]:
    """E4: accuracy by system, depth and criticality on the test sentences, the comparison
    with the baseline and the binomial model. ``systems`` lists the systems, reference first.
    """
    scored = sm.scored_responses(sm.with_baseline(responses, baseline))
    tested = scored.filter(F.col("sentence_col") == sm.TEST_SIDE)
    cells = sm.accuracy(tested, ["system", "inferential_depth", "is_critical_item"])
    coded = tested.withColumns(
        {
            "depth": design.ordinal("inferential_depth", design.DEPTH_CODES, default=2),
            "critical": design.flag(F.col("is_critical_item")),
        }
    )
    counted = models.binomial_cells(coded, "correct", ["system", "depth", "critical"])
    return {
        "accuracy": cells,
        "panels": sm.accuracy_panels(tested, ["system", "inferential_depth"], "is_critical_item"),
        "versus_baseline": sm.versus_baseline(cells, ["inferential_depth", "is_critical_item"]),
        "model": models.binomial_glm(counted, models.system_terms("system", systems, "depth", "critical")),
    }


def conformity_analysis(responses: DataFrame, embeddings: DataFrame, prototypes: DataFrame, key: str) -> dict[str, DataFrame]:
    """E2: conformity of every response, concept means at T=0.8 and the mixed model."""
    scored = cf.conformity(cf.attach_embeddings(responses, embeddings, key), prototypes, "concept_id").drop("embedding")
    at_main = scored.filter(F.col("temperature") == 0.8)
    coded = scored.withColumn("charged", design.flag(F.col("concept_type") == "charged"))
    return {
        "conformity": scored,
        "ranking": cf.concept_ranking(at_main, ["concept", "concept_type"], "conformity"),
        "model": models.lmm(coded, "conformity", models.interactions(["charged", "temperature"]), "concept"),
        "uncovered": design.coverage_gap(responses, prototypes, ["concept_id"]),
    }


def entropy_analysis(topics: DataFrame) -> dict[str, DataFrame]:
    """E2 at T=0.8: entropy per concept, model and preset, its ranking and the presets' stability; over all temperatures
    the mixed model of the default preset's entropy.

    ``topics`` has concept_id, concept_type, model, temperature and topic.
    """
    main = topics.filter(F.col("temperature") == 0.8)
    entropies = sm.preset_entropy(main, ["concept_id", "concept_type", "model"], "topic")
    pivoted = sm.config_pivot(entropies, ["concept_id", "model"])
    default = entropies.filter(F.col("config") == "default")
    warm = sm.preset_entropy(topics, ["concept_id", "concept_type", "model", "temperature"], "topic").filter(F.col("config") == "default")
    return {
        "entropy": entropies,
        "ranking": cf.concept_ranking(default, ["concept_id", "concept_type"], "entropy", descending=False),
        "stability": models.preset_stability(pivoted, list(sm.TOPIC_PRESETS)),
        "model": charge_model(warm),
    }


def charge_model(entropies: DataFrame) -> DataFrame:
    """E2: entropy ~ charged × temperature + (1 | concept). ``entropies`` has concept_id, concept_type, temperature and entropy."""
    coded = entropies.withColumn("charged", design.flag(F.col("concept_type") == "charged"))
    return models.lmm(coded, "entropy", models.interactions(["charged", "temperature"]), "concept_id")


def generation_model(entropies: DataFrame) -> DataFrame:
    """E5: entropy ~ generation × changing + (1 | concept). ``entropies`` has concept, concept_type, generation and entropy."""
    coded = entropies.withColumns(
        {
            "generation_ord": design.ordinal("generation", design.GENERATION_CODES),
            "changing": design.flag(F.col("concept_type") == "changing"),
        }
    )
    return models.lmm(coded, "entropy", models.interactions(["generation_ord", "changing"]), "concept")


def diachronic_analysis(responses: DataFrame, embeddings: DataFrame, prototypes: DataFrame, key: str) -> dict[str, DataFrame]:
    """E5: conformity across generations, its trajectory and the mixed model, with the concepts that lack a prototype."""
    scored = cf.conformity(cf.attach_embeddings(responses, embeddings, key), prototypes, "concept").drop("embedding")
    coded = scored.withColumns(
        {
            "generation_ord": design.ordinal("generation", design.GENERATION_CODES),
            "changing": design.flag(F.col("concept_type") == "changing"),
        }
    )
    return {
        "conformity": coded,
        "trajectory": cf.trajectory(coded, "concept", "generation_ord", ["concept_type"], "conformity"),
        "model": models.lmm(coded, "conformity", models.interactions(["generation_ord", "changing"]), "concept"),
        "uncovered": design.coverage_gap(responses, prototypes, ["concept"]),
    }


def quality_analysis(replies: DataFrame, reply: str = "reply") -> dict[str, DataFrame]:
    """E3, output side: scores from judge replies, then the three models of quality.

    ``replies`` holds the response metadata and the judge's raw JSON; unusable
    replies come back as ``quarantine``.
    """
    good, bad = files.split_scores(files.parse_scores(replies, reply, JUDGE_REPLY, SCORE_FIELDS))
    scored = good.withColumns(
        {"quality": design.row_mean(*SCORE_FIELDS), "complex": design.flag(F.col("complexity") == "high")}
    )
    means = sm.mean_and_sem(scored, ["domain", "level"], "quality")
    focal = scored.filter(F.col("domain").isin(*design.FOCAL_DOMAINS))
    flags = focal.withColumns({c: design.flag(F.col(c)) for c in design.COMPONENTS})
    attribution = models.ols(flags, "quality", models.interactions(list(design.COMPONENTS)), cells=list(design.COMPONENTS))
    return {
        "scores": scored,
        "quarantine": bad,
        "curves": means,
        "model": models.lmm(scored, "quality", models.interactions(["level", "complex"]), "domain", few=True),
        "monotonicity": models.linear_or_step(means, "level", "mean"),
        "attribution": attribution,
        "component_ranking": models.coefficient_ranking(attribution, list(design.COMPONENTS)),
        "gain": sm.level_gain(scored, "domain", "complexity", "level", "quality"),
    }


def effort_analysis(users: DataFrame, keys: Sequence[str] = ()) -> dict[str, DataFrame]:
    """E3, production side: effort-to-quality ratio and its partial correlation with education."""
    design.require_columns(users, ["time_on_task", "n_edits", "self_reported_difficulty", "output_quality"])
    ratios = sm.effort_to_quality(users, ["time_on_task", "n_edits", "self_reported_difficulty"], "output_quality")
    return {
        "ratios": ratios,
        "inequality": models.partial_correlation(ratios, "education_level", "effort_to_quality", "domain_familiarity", keys),
        "line": models.regression_band(ratios, "education_level", "effort_to_quality", keys),
    }


def cluster_analysis(responses: DataFrame, vectors: dict[str, DataFrame], key: str, dim: dict[str, int]) -> dict[str, DataFrame]:
    """E1: silhouettes by lemma and by context for each embedder, their seed stability and the mean difference per stratum."""
    groups = ["model", "ambiguity_stratum"]
    paraphrase = F.col("is_paraphrase")
    points = {name: cf.attach_embeddings(responses, v, key) for name, v in vectors.items()}
    results = silhouette.union_embedders(
        {n: silhouette.context_against_lemma(p, groups, "term", "prompt_key", "embedding", paraphrase) for n, p in points.items()}
    )
    return {
        "silhouette": results,
        "stability_lemma": silhouette.union_embedders(
            {n: silhouette.silhouette_stability(p, groups, "term", "embedding", dim[n]) for n, p in points.items()}
        ),
        "stability_context": silhouette.union_embedders(
            {n: silhouette.silhouette_stability(p, groups, "prompt_key", "embedding", dim[n]) for n, p in points.items()}
        ),
        "by_stratum": silhouette.delta_by_stratum(results, "ambiguity_stratum"),
    }
