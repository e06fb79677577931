"""Row-local text expressions. Everything here is a built-in Column expression."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the characters Python's str.strip() removes.
SPACE_CLASS = (
    r"[\x{0009}-\x{000D}\x{001C}-\x{0020}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)
# Label names of the sense classifier.
ENCYCLOPEDIC = "encyclopedic"
NEITHER = "neither"
# Fixed value: prefix the passage embedder expects.
PASSAGE_PREFIX = "passage: "
# Flesch-Kincaid grade coefficients.
FK_SENTENCE, FK_SYLLABLE, FK_OFFSET = 0.39, 11.8, 15.59

WORD_PATTERN = r"[\p{L}\p{M}]+"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: str | Column) -> Column:
    """Remove leading and trailing whitespace, Unicode spaces included."""
    return F.regexp_replace(col(c), f"^{SPACE_CLASS}+|{SPACE_CLASS}+$", "")


def non_blank(c: str | Column) -> Column:
    return F.length(strip(c)) > 0


def words(c: str | Column) -> Column:
    """Lower-cased letter runs, in text order."""
    return F.regexp_extract_all(F.lower(col(c)), F.lit(WORD_PATTERN), F.lit(0))


def render(template: str, **values: str | Column) -> Column:
    """Fill the named placeholders of ``template``; any other brace stays as it is.

    The template is cut at its placeholders once, so text coming in through a
    value is never searched for placeholders itself.
    """
    names = "|".join(re.escape(name) for name in values)
    pieces = re.split(r"\{(" + names + r")\}", template) if names else [template]
    parts = [
        col(values[piece]).cast("string") if i % 2 else F.lit(piece)
        for i, piece in enumerate(pieces)
        if i % 2 or piece
    ]
    return F.concat(*parts) if parts else F.lit("")


def embed_input(c: str | Column) -> Column:
    return F.concat(F.lit(PASSAGE_PREFIX), col(c))


def prompt_hash(prompt: str | Column) -> Column:
    return F.substring(F.md5(col(prompt)), 1, 8)


def call_id(prompt: str | Column, model: str | Column, temperature: str | Column, index: str | Column) -> Column:
    """``basename_hash_index``, where the hash covers prompt, model, temperature and index."""
    digest = F.md5(F.concat(col(prompt), col(model), col(temperature).cast("string"), col(index).cast("string")))
    basename = F.element_at(F.split(col(model), "/"), -1)
    return F.concat_ws("_", basename, F.substring(digest, 1, 8), col(index).cast("string"))


def temperature_tag(temperature: str | Column) -> Column:
    """``T08`` for 0.8."""
    return F.concat(F.lit("T"), F.replace(col(temperature).cast("string"), F.lit("."), F.lit("")))


def slice_tag(model: str | Column, temperature: str | Column) -> Column:
    return F.concat(col(model), F.lit("_"), temperature_tag(temperature))


def two_way_tag(temperature: str | Column) -> Column:
    """Tag of the two-temperature design: ``T0`` for greedy decoding, ``T07`` otherwise."""
    return F.when(col(temperature) == 0.0, "T0").otherwise("T07")


def reading_label(response: str | Column, truth: str | Column) -> Column:
    """Encyclopedic if the response holds the ground truth, ignoring case; null if either is missing."""
    response, truth = col(response), col(truth)
    hit = F.contains(F.lower(response), F.lower(truth))
    return F.when(hit, ENCYCLOPEDIC).when(hit.isNotNull(), NEITHER)


def part_of_speech(synset: str | Column) -> Column:
    """Second-last dotted part of a synset id, ``n`` where the id has no dot."""
    parts = F.split(col(synset), r"\.")
    return F.when(F.size(parts) >= 2, F.try_element_at(parts, F.lit(-2))).otherwise("n")


def sentence_count(c: str | Column) -> Column:
    return F.greatest(F.regexp_count(col(c), F.lit(r"[.!?]+")), F.lit(1))


def syllable_count(c: str | Column) -> Column:
    return F.regexp_count(F.lower(col(c)), F.lit(r"[aeiouyáàâäéèêëíîïóôöúûüœæ]+"))


def flesch_kincaid(n_words: Column, n_sentences: Column, n_syllables: Column) -> Column:
    return (
        F.lit(FK_SENTENCE) * F.try_divide(n_words, n_sentences)
        + F.lit(FK_SYLLABLE) * F.try_divide(n_syllables, n_words)
        - F.lit(FK_OFFSET)
    )
