"""Word frequency, sense counts, dominant sense and critical-item tiers."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import (
    ENCYCLOPEDIC,
    col,
    flesch_kincaid,
    part_of_speech,
    sentence_count,
    strip,
    syllable_count,
    words,
)
from ..session import kept

# Fewest tagged occurrences for the corpus to decide the dominant sense,
# and the labels recorded for where that sense came from.
MIN_OCCURRENCES = 5
FROM_CORPUS, FROM_INVENTORY, FROM_NOWHERE = "semcor", "wordnet_ordering", "none"
UNKNOWN = "UNKNOWN"
# Critical-item tiers.
TIER_AUTO, TIER_SENSE, TIER_MANUAL, TIER_NONE = "T1_auto", "T2_auto", "T3_manual", "-"
# Lowest Zipf frequency per inferential depth, Zipf band of terms,
# lowest Zipf frequency of contrast words, and synset range per ambiguity band.
DEPTH_THRESHOLDS = {"shallow": 3.5, "medium": 3.2, "deep": 2.8}
TERM_ZIPF = (3.5, 6.5)
CONTRAST_ZIPF = 4.0
# Characters of a word by which a passage without inner words is looked up.
RUN = 4
BAND_SYNSETS = {"high": (4, 99), "medium": (2, 3), "near_monosemous": (1, 2)}


def tokens(corpus: DataFrame, text: str, *keep: str) -> DataFrame:
    """One row per word, in whole texts."""
    return corpus.select(*keep, F.explode(words(text)).alias("token"))


def token_counts(corpus: DataFrame, text: str) -> DataFrame:
    return tokens(corpus, text).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def corpus_size(corpus: DataFrame, text: str) -> DataFrame:
    """Words in all texts, as one row: sizes are added up, nothing is grouped."""
    return corpus.agg(F.sum(F.size(words(text))).alias("n"))


def zipf_table(counts: DataFrame, total: Column | None = None) -> DataFrame:
    """Zipf frequency (log10 of occurrences per billion words), two decimals.

    ``counts`` may be a part of the vocabulary if ``total`` gives the words of the whole corpus.
    """
    total = counts.agg(F.sum("n")).scalar() if total is None else total
    return counts.select("token", F.round(F.log10(F.col("n") / total * F.lit(1e9)), 2).alias("zipf"))


def with_zipf(df: DataFrame, zipf: DataFrame, word: str, out: str) -> DataFrame:
    """Look up a word's Zipf frequency: 0 if the corpus lacks it, null if there is no word."""
    key = F.lower(F.col(word))
    side = zipf.select(F.col("token").alias("_token"), F.col("zipf").alias("_zipf"))
    value = F.when(F.length(F.col(word)) > 0, F.coalesce(F.col("_zipf"), F.lit(0.0)))
    return df.join(side, key == F.col("_token"), "left").withColumn(out, value).drop("_token", "_zipf")


def with_phrase_zipf(df: DataFrame, counts: DataFrame, phrase: str, out: str) -> DataFrame:
    """Zipf frequency of a phrase: its words' frequencies combined as 1 / Σ 1/f.

    0 if a word is unseen, null if the phrase has no word. A phrase's words travel under
    two hashes of it, never with its text; copies of a phrase add up alike and are divided out.
    """
    total = counts.agg(F.sum("n")).scalar()
    frequency = counts.select("token", (F.col("n") / total).alias("_f"))
    marks = [F.xxhash64(F.lit(i), F.col(phrase)).alias(f"_mark{i}") for i in range(2)]
    parts = df.select(*marks, F.posexplode(words(phrase)).alias("_at", "token")).join(frequency, "token", "left")
    copies = F.count_if(F.col("_at") == 0)
    zipf = F.round(F.log10(F.lit(1e9) / (F.sum(1 / F.col("_f")) / copies)), 2)
    combined = parts.groupBy("_mark0", "_mark1").agg(F.when(F.count_if(F.col("_f").isNull()) == 0, zipf).otherwise(0.0).alias(out))
    rest = [c for c in df.columns if c != phrase]
    return df.select("*", *marks).join(combined, ["_mark0", "_mark1"], "left").select(phrase, *rest, out)


def sense_counts(tagged: DataFrame, inventory: DataFrame | None = None, expand_lemmas: bool = True) -> DataFrame:
    """Occurrences per (lemma, synset) in a sense-tagged corpus of (lemma, synset) rows.

    With ``expand_lemmas`` each tag credits every lemma of its synset, as listed in
    ``inventory``. Tags are counted per synset before the expansion, so it
    multiplies counted rows and not the corpus.
    """
    if not expand_lemmas:
        return tagged.groupBy("lemma", "synset").agg(F.count(F.lit(1)).alias("n"))
    if inventory is None:
        raise ValueError("expanding lemmas needs the synset inventory")
    per_synset = tagged.groupBy("synset").agg(F.count(F.lit(1)).alias("n"))
    members = inventory.select("synset", "lemma").distinct()
    return per_synset.join(members, "synset").select("lemma", "synset", "n")


def synsets_per_word(inventory: DataFrame) -> DataFrame:
    return inventory.groupBy("lemma").agg(F.count_distinct("synset").alias("n_synsets"))


def dominant_sense(items: DataFrame, counts: DataFrame, inventory: DataFrame, word: str, pos: str) -> DataFrame:
    """Add ``dominant``, ``sense_source`` and ``sense_n`` to items keyed by word and part of speech.

    The corpus decides when the word has enough tagged occurrences under that part
    of speech; else the first inventory sense of that part of speech, else of any;
    else unknown. Equal counts are settled by synset name. ``only_words`` keeps both
    tables to the words that items name. What is known of a word is one row of a few
    entries, looked up once per item.
    """
    first = F.min(F.struct((-F.col("n")).alias("neg"), F.col("synset").alias("synset")))
    corpus = (
        counts.withColumn("_pos", part_of_speech("synset"))
        .groupBy(F.col("lemma").alias("_lemma"), "_pos")
        .agg(F.sum("n").alias("_total"), first.alias("_top"))
        .filter(F.col("_total") >= MIN_OCCURRENCES)
        .groupBy("_lemma")
        .agg(F.map_from_entries(F.collect_list(F.struct("_pos", F.struct(F.col("_top.synset").alias("synset"), (-F.col("_top.neg")).alias("n"))))).alias("_by_corpus"))
    )
    # One row per word: its first sense under each part of speech, a handful of entries.
    listed = F.min(F.struct(F.col("sense_rank").alias("rank"), F.col("synset").alias("synset")))
    senses = (
        inventory.groupBy(F.col("lemma").alias("_word"), part_of_speech("synset").alias("_ipos"))
        .agg(listed.alias("_first"))
        .groupBy("_word")
        .agg(
            F.map_from_entries(F.collect_list(F.struct("_ipos", "_first"))).alias("_by_pos"),
            F.min("_first").alias("_any"),
        )
    )
    # Both sides of a word in one row, so that the items are moved once at most.
    known = corpus.join(senses, F.col("_lemma") == F.col("_word"), "full").select(
        F.coalesce("_lemma", "_word").alias("_known"), "_by_corpus", "_by_pos", "_any"
    )
    joined = items.join(known, F.col(word) == F.col("_known"), "left").withColumn("_seen", F.try_element_at("_by_corpus", F.col(pos)))
    joined = joined.withColumns({"_corpus": F.col("_seen.synset"), "_n": F.col("_seen.n")})
    fallback = F.coalesce(F.try_element_at("_by_pos", F.col(pos)), F.col("_any"))["synset"]
    return joined.select(
        *items.columns,
        F.coalesce("_corpus", fallback, F.lit(UNKNOWN)).alias("dominant"),
        F.when(F.col("_corpus").isNotNull(), FROM_CORPUS)
        .when(fallback.isNotNull(), FROM_INVENTORY)
        .otherwise(FROM_NOWHERE)
        .alias("sense_source"),
        F.coalesce("_n", F.lit(0)).alias("sense_n"),
    )


def only_words(df: DataFrame, key: str, items: DataFrame, *columns: str) -> DataFrame:
    """Rows whose ``key`` is a word in one of the items' columns, in lower case or as written.

    Applied to counted words, so that the words of a corpus are never moved one by one.
    """
    named = F.array_distinct(F.flatten(F.array(*[F.array(F.col(c), F.lower(c)) for c in columns])))
    return df.join(items.select(F.explode(named).alias(key)).distinct(), key, "left_semi")


def annotate_items(items: DataFrame, meta: DataFrame, key: str, defaults: Mapping[str, str]) -> DataFrame:
    """Left join of annotations; a missing item gets the defaults."""
    joined = items.join(meta.select(key, *defaults), key, "left")
    return joined.withColumns({name: F.coalesce(F.col(name), F.lit(value)) for name, value in defaults.items()})


def mark_members(df: DataFrame, members: DataFrame, key: str, out: str) -> DataFrame:
    """Flag rows whose key is on a list, keeping all rows and their number."""
    listed = members.select(key).distinct().withColumn("_listed", F.lit(True))
    return df.join(listed, key, "left").withColumn(out, F.coalesce("_listed", F.lit(False))).drop("_listed")


def update_columns(df: DataFrame, analysis: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Replace the named columns by the analysis table's values for the same key."""
    order = [*df.columns, *[c for c in columns if c not in df.columns]]
    return df.drop(*columns).join(analysis.select(key, *columns), key, "left").select(*order)


def sense_mismatch(enc: str = "enc_synset", dic: str = "dict_synset", dominant: str = "dominant") -> Column:
    return (col(enc) != col(dic)) & (col(dominant) != col(enc))


def freq_lower(enc: str = "zipf_enc", dic: str = "zipf_dict") -> Column:
    return F.coalesce(col(enc) < col(dic), F.lit(False))


def tier(mismatch: Column, lower: Column, manual: Column) -> Column:
    return (
        F.when(mismatch & lower, TIER_AUTO).when(mismatch, TIER_SENSE).when(manual, TIER_MANUAL).otherwise(TIER_NONE)
    )


def critical_tiers(df: DataFrame, manual: str = "in_manual") -> DataFrame:
    """Add the two tests, the tier and whether the item is critical."""
    tested = df.withColumns({"sense_mismatch": sense_mismatch(), "freq_lower": freq_lower()})
    tiered = tested.withColumn("tier", tier(F.col("sense_mismatch"), F.col("freq_lower"), F.col(manual)))
    return tiered.withColumn("is_critical_item", F.col("tier") != TIER_NONE)


def verification_source(source: str = "sense_source", n: str = "sense_n", manual: str = "in_manual") -> Column:
    return F.concat(
        F.col(source), F.lit("(n="), F.col(n).cast("string"), F.lit(")"), F.when(F.col(manual), "+manual").otherwise("")
    )


def tier_summary(df: DataFrame, depth: str, tier: str = "tier") -> DataFrame:
    """Items, critical items and items per tier, by depth and in total (null depth)."""
    return df.rollup(depth).agg(
        F.count(F.lit(1)).alias("n_items"),
        F.count_if(F.col(tier) != TIER_NONE).alias("n_critical"),
        F.count_if(F.col(tier) == TIER_AUTO).alias("n_t1"),
        F.count_if(F.col(tier) == TIER_SENSE).alias("n_t2"),
        F.count_if(F.col(tier) == TIER_MANUAL).alias("n_t3"),
    )


def critical_listing(df: DataFrame, depth: str, key: str) -> DataFrame:
    return df.filter("is_critical_item").orderBy(depth, key)


def below_threshold(df: DataFrame, stratum: str, value: str, thresholds: Mapping[str, float]) -> DataFrame:
    """Rows whose value lies under the threshold of their stratum, with that threshold."""
    pairs = [F.lit(x) for item in thresholds.items() for x in item]
    limit = F.try_element_at(F.create_map(*pairs), F.col(stratum))
    return df.withColumn("threshold", limit).filter(F.col(value) < F.col("threshold"))


def band_flags(
    df: DataFrame, band: str, n_synsets: str, zipf: str, bands: Mapping[str, tuple[int, int]], zipf_range: tuple[float, float]
) -> DataFrame:
    """Flag words outside their band; both ends are reported, since only checking the lower one lets words slip."""
    low = F.create_map(*[F.lit(x) for name, (lo, _) in bands.items() for x in (name, lo)])
    high = F.create_map(*[F.lit(x) for name, (_, hi) in bands.items() for x in (name, hi)])
    return df.withColumns(
        {
            "below_band": F.col(n_synsets) < F.try_element_at(low, F.col(band)),
            "above_band": F.col(n_synsets) > F.try_element_at(high, F.col(band)),
            "zipf_outside": ~F.col(zipf).between(*zipf_range),
        }
    )


def contrast_check(df: DataFrame, zipf: DataFrame, contrast: str, minimum: float = CONTRAST_ZIPF) -> DataFrame:
    """Zipf frequency of the first word of a contrast phrase, and whether it is too rare."""
    first = F.split(strip(contrast), r"\s+")[0]
    checked = with_zipf(df.withColumn("contrast_word", first), zipf, "contrast_word", "contrast_zipf")
    return checked.withColumn("contrast_low", F.col("contrast_zipf") < F.lit(minimum))


def concept_documents(corpus: DataFrame, concepts: DataFrame, doc_id: str, text: str, k: int = 100) -> DataFrame:
    """First ``k`` documents by id that contain a concept's lemma.

    Each document offers its distinct words to an equi-join with the lemmas. The
    limit is the operator's definition; Spark applies it before the shuffle, so a
    lemma found everywhere sends at most ``k`` rows per task.
    """
    from pyspark.sql import Window

    offered = corpus.select(doc_id, F.explode(F.array_distinct(words(text))).alias("lemma"))
    hits = offered.join(concepts.select("concept_id", F.lower("lemma").alias("lemma")), "lemma")
    order = Window.partitionBy("concept_id").orderBy(doc_id)
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def cooccurrence(corpus: DataFrame, text: str, window: int = 2, wanted: DataFrame | None = None) -> DataFrame:
    """Counts of unordered word pairs at most ``window`` words apart, over whole texts.

    The pairs of a text are made from shifted copies of its word array: words ×
    window of them, with no join; counting combines them before the shuffle. With
    ``wanted`` (word_a, word_b) only those pairs are kept: before the counting if they
    are few enough to be sent to all tasks, else of the counted pairs.
    """
    gaps = range(1, window + 1)
    shifted = [F.slice("_words", F.lit(1 + gap), F.greatest(F.size("_words"), F.lit(0))).alias(f"_w{gap}") for gap in gaps]
    copies = corpus.select(words(text).alias("_words")).filter(F.size("_words") > 1).select(F.col("_words").alias("_w0"), *shifted)
    runs = copies.select(F.inline(F.arrays_zip(*[f"_w{gap}" for gap in (0, *gaps)])))
    ends = [F.struct(F.least("_w0", f"_w{gap}").alias("word_a"), F.greatest("_w0", f"_w{gap}").alias("word_b"), F.col(f"_w{gap}").alias("_end")) for gap in gaps]
    pairs = runs.select(F.inline(F.array(*ends))).filter(F.col("_end").isNotNull()).drop("_end")
    counted = pairs.groupBy("word_a", "word_b").agg(F.count(F.lit(1)).alias("n"))
    return counted if wanted is None else counted.join(wanted, ["word_a", "word_b"], "left_semi")


def asked_pairs(items: DataFrame, word: str, *contexts: str) -> DataFrame:
    """Distinct unordered pairs of an item's word and its context words."""
    asked = [F.struct(F.least(word, c).alias("word_a"), F.greatest(word, c).alias("word_b")) for c in contexts]
    return items.select(F.inline(F.array(*asked))).distinct()


def cooccurrence_baseline(items: DataFrame, pairs: DataFrame, word: str, enc_ctx: str, dict_ctx: str) -> DataFrame:
    """Sense the co-occurrence model picks: that whose context word is seen more often with the target.

    A tie goes to the dictionary sense.
    """
    out = items
    for name, context in (("n_enc", enc_ctx), ("n_dict", dict_ctx)):
        side = pairs.select(F.col("word_a").alias("_a"), F.col("word_b").alias("_b"), F.col("n").alias("_n"))
        a, b = F.least(word, context), F.greatest(word, context)
        out = out.join(side, (a == F.col("_a")) & (b == F.col("_b")), "left")
        out = out.withColumn(name, F.coalesce("_n", F.lit(0))).drop("_a", "_b", "_n")
    return out.withColumn("predicted", F.when(F.col("n_enc") > F.col("n_dict"), ENCYCLOPEDIC).otherwise("dictionary"))


def dictionary_baseline(items: DataFrame, enc: str = "enc_synset", dominant: str = "dominant") -> DataFrame:
    """Sense the most-frequent-sense model picks."""
    return items.withColumn(
        "predicted", F.when(F.col(dominant) == F.col(enc), ENCYCLOPEDIC).otherwise("dictionary")
    )


def readability(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """Type-token ratio and Flesch-Kincaid grade per text; null for a text without words.

    Each count is made once, as a column, before the ratios use it.
    """
    counted = df.select(
        *keep,
        words(text).alias("_w"),
        sentence_count(text).alias("_sentences"),
        syllable_count(text).alias("_syllables"),
    ).select(*keep, F.size("_w").alias("_n"), F.size(F.array_distinct("_w")).alias("_distinct"), "_sentences", "_syllables")
    return counted.select(
        *keep,
        F.try_divide("_distinct", "_n").alias("ttr"),
        flesch_kincaid(F.col("_n"), F.col("_sentences"), F.col("_syllables")).alias("grade"),
    )


def marker_counts(corpus: DataFrame, lexicon: DataFrame, text: str, *keep: str) -> DataFrame:
    """Occurrences of lexicon words per category, and the documents holding at least one.

    Words meet the lexicon before anything is counted, a text's own hits are counted within its row of the corpus.
    """
    listed = lexicon.select("token", "category").distinct()
    marked = corpus.select(*keep, F.monotonically_increasing_id().alias("_row"), words(text).alias("_w"))
    hits = marked.select(*keep, "_row", F.explode("_w").alias("token")).join(listed, "token")
    per_text = hits.groupBy(*keep, "category", "_row").agg(F.count(F.lit(1)).alias("_n"))
    return per_text.groupBy(*keep, "category").agg(F.sum("_n").alias("n_markers"), F.count(F.lit(1)).alias("n_documents"))


def containing_passages(
    responses: DataFrame, passages: DataFrame, response_id: str, text: str, passage_id: str, passage: str, anchor: int = 5
) -> DataFrame:
    """Which passages stand in which responses, ignoring case; each pair once per row that has it.

    A passage is looked up by an anchor that any text around it leaves whole: the run of its inner words, ``anchor`` of them
    at most; if it has none, the first ``RUN`` characters of its longest word; if it has no word, its first character.
    Responses offer the hashes of the kinds of anchors that occur, which gives pairs of ids; only those meet the texts.
    A null or empty passage stands in no response. The anchors are written to the shared folder when this is called.
    """
    longest = F.array_max(F.transform("_w", lambda w: F.struct(F.length(w).alias("l"), w.alias("w"))))["w"]
    inner, start = F.least(F.size("_w") - 2, F.lit(anchor)), F.least(F.length(longest), F.lit(RUN))
    lowered = passages.select(F.col(passage_id), F.lower(F.col(passage)).alias("_passage"), words(passage).alias("_w"))
    keyed = lowered.filter(F.length("_passage") > 0).select(
        passage_id,
        "_passage",
        # Kinds: the number of inner words, less than zero for characters of a word, zero for one that is in no word.
        F.when(inner > 0, inner).when(F.size("_w") > 0, -start).otherwise(0).alias("_kind"),
        F.when(inner > 0, F.xxhash64(F.slice("_w", F.lit(2), inner)))
        .when(F.size("_w") > 0, F.xxhash64(F.array(F.left(longest, start))))
        .otherwise(F.xxhash64(F.array(F.left("_passage", F.lit(1)))))
        .alias("_key"),
    )
    # Written down, so that Spark knows how few the anchors are and the offers need not be moved to them.
    keyed = kept(keyed, "anchors")
    kinds = keyed.agg(F.collect_set("_kind")).scalar()

    def offer(kind: int) -> Column:
        if kind > 0:
            starts = F.sequence(F.lit(1), F.greatest(F.size("_w") - (kind - 1), F.lit(1)))
            marks = F.transform(starts, lambda at: F.xxhash64(F.slice("_w", at, F.lit(kind))))
        elif kind:
            # A run of letters lies in one word, and a text has far fewer different words than characters.
            long = F.filter(F.array_distinct("_w"), lambda w: F.length(w) >= -kind)
            each = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + (kind + 1)), lambda at: F.substring(w, at, F.lit(-kind)))
            marks = F.transform(F.array_distinct(F.flatten(F.transform(long, each))), lambda run: F.xxhash64(F.array(run)))
        else:
            found = F.regexp_extract_all("_text", F.lit(r"([^\p{L}\p{M}])"), F.lit(1))
            marks = F.transform(F.array_distinct(found), lambda run: F.xxhash64(F.array(run)))
        return F.when(F.array_contains("_kinds", kind), marks).otherwise(F.array().cast("array<bigint>"))

    whole = responses.select(response_id, F.lower(F.col(text)).alias("_text"))
    split = whole.select(response_id, "_text", words("_text").alias("_w")).withColumn("_kinds", kinds)
    offers = F.flatten(F.array(*[offer(kind) for kind in range(-RUN, anchor + 1)]))
    offered = split.select(response_id, F.explode(F.array_distinct(offers)).alias("_key"))
    candidates = offered.join(keyed.select(passage_id, "_key"), "_key").select(response_id, passage_id).distinct()
    verified = candidates.join(whole, response_id).join(keyed.select(passage_id, "_passage"), passage_id)
    return verified.filter(F.contains("_text", "_passage")).select(response_id, passage_id)
