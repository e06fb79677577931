"""Declared schemas of every table the operators read; nothing is inferred."""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DoubleType,
    FloatType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

_TYPES = {
    "string": StringType(),
    "int": IntegerType(),
    "long": LongType(),
    "double": DoubleType(),
    "boolean": BooleanType(),
    "timestamp": TimestampType(),
}


def _struct(**fields: str) -> StructType:
    return StructType([StructField(name, _TYPES[kind]) for name, kind in fields.items()])


POLYSEMOUS_TERMS = _struct(
    item_id="string",
    target_word="string",
    ambiguity_band="string",
    n_wordnet_synsets="int",
    zipf_frequency="double",
    prompt_P1="string",
    prompt_P2="string",
    prompt_P3="string",
    prompt_P4="string",
    prompt_P5="string",
    P2_implied_sense="string",
    P4_contrast_word="string",
    note="string",
)

CONCEPTS = _struct(
    concept_id="string",
    concept="string",
    concept_type="string",
    stereotypy_rating_mean="double",
    stereotypy_rating_icc="double",
    coca_freq_rank="int",
    wikipedia_article_length_chars="long",
    matched_control_id="string",
    prototype_embedding_file="string",
    notes="string",
)

MINIMAL_PAIRS = _struct(
    item_id="string",
    target_word="string",
    sentence_a="string",
    sentence_b="string",
    ground_truth_reading="string",
    inferential_depth="string",
    is_critical_item="boolean",
    corpus_dominant_sense="string",
    encyclopedic_target_sense="string",
    verification_source="string",
    zipf_frequency="double",
    note="string",
)

CRITICAL_ANALYSIS = _struct(
    item_id="string",
    target_word="string",
    inferential_depth="string",
    corpus_dominant_sense="string",
    verification_source="string",
    encyclopedic_target_sense="string",
    dict_synset="string",
    enc_ctx_word="string",
    dict_ctx_word="string",
    zipf_enc_ctx="double",
    zipf_dict_ctx="double",
    sense_mismatch="boolean",
    freq_lower="boolean",
    tier="string",
    is_critical_item="boolean",
    manual_rationale="string",
)

_RESPONSE = {"temperature": "double", "prompt": "string", "model": "string", "response_index": "int", "response": "string"}

RESPONSES_E1 = _struct(
    term_id="string", term="string", ambiguity_stratum="string", prompt_key="string", is_paraphrase="boolean", **_RESPONSE
)
RESPONSES_E2 = _struct(concept_id="string", concept="string", concept_type="string", **_RESPONSE)
RESPONSES_E3 = _struct(
    domain="string",
    complexity="string",
    condition_id="string",
    level="int",
    D="boolean",
    R="boolean",
    V="boolean",
    C="boolean",
    is_focal="boolean",
    prompt="string",
    model="string",
    response_index="int",
    response="string",
)
RESPONSES_E4 = _struct(
    item_id="string",
    target_word="string",
    sentence_col="string",
    ground_truth="string",
    inferential_depth="string",
    is_critical_item="boolean",
    **_RESPONSE,
)
BASELINE_E4 = _struct(
    item_id="string",
    target_word="string",
    sentence_col="string",
    ground_truth="string",
    inferential_depth="string",
    is_critical_item="boolean",
    model="string",
    temperature="double",
    response="string",
)
RESPONSES_E5 = _struct(
    concept="string",
    concept_type="string",
    generation="string",
    model="string",
    temperature="double",
    response_index="int",
    response="string",
)
SCORE_FIELDS = ("factual_accuracy", "practical_actionability", "domain_precision")
JUDGE_REPLY = StructType([*_struct(**{f: "int" for f in SCORE_FIELDS}), StructField("brief_justification", StringType())])
JUDGE_SCORES = StructType([*RESPONSES_E3, *JUDGE_REPLY, StructField("judge_model", StringType())])
USER_STUDY = _struct(
    time_on_task="double",
    n_edits="int",
    self_reported_difficulty="int",
    output_quality="double",
    education_level="int",
    domain_familiarity="double",
)
CORPUS_PARAGRAPHS = _struct(
    concept_id="string", concept="string", concept_type="string", source="string", para_index="int", text="string"
)
USAGE = _struct(prompt_tokens="long", completion_tokens="long", total_tokens="long")
CALL_LOG = StructType(
    [
        *_struct(ts="timestamp", model="string", temperature="double", seed="int", prompt_hash="string", n_responses="int"),
        StructField("usage", USAGE),
    ]
)
EMBEDDINGS = StructType([StructField("response_id", StringType()), StructField("embedding", ArrayType(FloatType()))])
# One stored reply of the encyclopedia's page API.
PAGE_REPLY = "query struct<pages:map<string,struct<title:string,extract:string,revisions:array<struct<revid:bigint>>>>>"

# Column names of the polysemous-term table as the response tables use them.
TERM_COLUMNS = {"item_id": "term_id", "target_word": "term", "ambiguity_band": "ambiguity_stratum"}
TERM_PROMPTS = {
    "neutral": "prompt_P1",
    "explicit_a": "prompt_P4",
    "explicit_b": "prompt_P5",
    "paraphrase_a": "prompt_P2",
    "paraphrase_b": "prompt_P3",
}
