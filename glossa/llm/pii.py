"""Personal data: formal patterns, and terms that give the protected values away.

Patterns find e-mail addresses, IP addresses, card and phone numbers. The values that recur are the protected entities.
Corpus co-occurrence then says how strongly a term reveals an entity: PMI(entity; term), in units of the entity's own
information, so 1 means that who sees the term knows the entity. Document counts are of distinct texts over the whole corpus;
a term and an entity co-occur in the texts that hold both, wherever they stand. Terms at or above
``GENERALISE`` are replaced by their kind in the texts that hold the entity, those at or above ``REMOVE`` are removed.

Only built-in functions. Pairs are formed only of entities and terms that enough texts hold, and only of terms rare enough
to reach ``GENERALISE``. Only texts that hold entities are taken apart for pairs. A term's texts are its rows less the
repeated ones, which the texts with copies tell, so only those are moved to be counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored
from .spans import apart, before, found, joined, let, named, none, replaced

# The kinds in their order.
KINDS = ("email", "ip", "card", "phone")
TERM = "term"
# Leftmost matches start where a run of their characters starts, or where the last match ended; possessive runs keep
# long texts linear.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
WORD = r"[\p{L}\p{N}]+"
# Distinct texts in which an entity and a term must meet; disclosures from which a term is generalised and removed.
SUPPORT, GENERALISE, REMOVE = 3, 0.7, 0.9


def digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def luhn(v: Column) -> Column:
    """Whether 13 to 19 digits pass the check sum."""
    d = F.split(F.reverse(digits(v)), "")

    def add(acc: Column, x: Column) -> Column:
        n = x.cast("int")
        twice = F.when(n > 4, 2 * n - 9).otherwise(2 * n)
        return F.struct((acc["sum"] + F.when(acc["odd"], twice).otherwise(n)).alias("sum"), (~acc["odd"]).alias("odd"))

    start = F.struct(F.lit(0).alias("sum"), F.lit(False).alias("odd"))
    passed = F.aggregate(F.filter(d, lambda x: x != ""), start, add, lambda acc: acc["sum"] % 10 == 0)
    return F.when(F.length(digits(v)).between(13, 19), passed).otherwise(False)


def base_spans(text: Column) -> dict[str, Column]:
    some = lambda needed, spans: F.when(needed, spans).otherwise(none())
    number = text.rlike("[0-9]")
    return {
        "email": some(F.contains(text, F.lit("@")), found(text, EMAIL)),
        "ip": some(number, found(text, IP, lambda v: v.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$"))),
        "card": some(number, found(text, CARD, luhn)),
        "phone": some(F.contains(text, F.lit("+")), found(text, PHONE, lambda v: F.length(digits(v)).between(9, 15))),
    }


def words_of(text: Column) -> Column:
    """Distinct lower-case words."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)))


def with_disclosure(spans: Column, disclosure: Column) -> Column:
    """Spans with one more field, ``d``."""
    fields = ("s", "k", "e", "kind", "v")
    return F.transform(spans, lambda x: F.struct(*[x[f].alias(f) for f in fields], disclosure.alias("d")))


def term_spans(text: Column, terms: Column) -> Column:
    """The places of ``terms`` (array of term, disclosure) in a text, in no order.

    Words and terms are sorted into one list, a term before the words that equal it, so each word is held against one term.
    """
    item = lambda w, s, e, v, d: F.struct(w.alias("w"), s.alias("s"), e.alias("e"), v.alias("v"), d.alias("d"))
    no_place, no_value = F.lit(-1), F.lit(None).cast("double")
    words = F.transform(found(text, WORD), lambda x: item(F.lower(x["v"]), x["s"], x["e"], x["v"], no_value))
    marks = F.transform(terms, lambda t: item(t["term"], no_place, no_place, F.lit(""), t["disclosure"]))

    term = F.struct(F.lit(None).cast("string").alias("w"), no_value.alias("d"))
    latest = lambda a, x: F.when(x["w"].isNull(), a).otherwise(x)

    def span(x: Column, t: Column) -> Column:
        kind, k = F.lit(TERM).alias("kind"), F.lit(len(KINDS)).alias("k")
        return F.when((x["s"] >= 0) & (x["w"] == t["w"]), F.struct(x["s"].alias("s"), k, x["e"].alias("e"), kind, x["v"].alias("v"), t["d"].alias("d")))

    def placed(xs: Column) -> Column:
        own = F.transform(xs, lambda x: F.struct(F.when(x["s"] < 0, x["w"]).alias("w"), F.when(x["s"] < 0, x["d"]).alias("d")))
        return F.zip_with(xs, before(own, term, latest, "struct<w:string,d:double>"), span)

    return F.filter(let(F.sort_array(F.concat(marks, words)), placed), lambda x: x.isNotNull())


def disclosing_terms(held: DataFrame, free: DataFrame, support: int = SUPPORT, least: float = GENERALISE) -> tuple[DataFrame, DataFrame]:
    """(entity, term, disclosure) of the terms that reveal an entity, and (mark, entity) of the entities' texts.

    ``held`` has ``mark`` (hash of the text), ``text`` and ``base`` (array of spans, not empty); ``free`` has mark and text of
    the texts without entities. An entity that every text holds has no
    information to give away and no disclosing terms.
    """
    entity = F.transform("base", lambda x: F.lower(x["v"]))
    texts = held.select("mark", "text").union(free)
    near = held.select("mark", F.array_distinct(entity).alias("entities"), words_of(F.col("text")).alias("words"))
    near = stored(near, "near")
    held = near.select("mark", F.explode("entities").alias("entity")).groupBy("mark", "entity").agg(F.lit(1).alias("one"))
    copies = stored(texts.groupBy("mark").agg(F.count("*").alias("n")), "copies")
    total = copies.count()
    entities = held.groupBy("entity").agg(F.count("*").alias("with_entity")).where(F.col("with_entity").between(support, total - 1))
    held = stored(held.join(entities, "entity").select("mark", "entity", "with_entity"), "held")
    marks = held.select("mark").distinct()
    words = near.select("mark", F.explode("words").alias("term")).join(marks, "mark", "left_semi").groupBy("mark", "term").agg(F.lit(1).alias("one"))
    words = stored(words.select("mark", "term"), "words")
    usable = stored(words.groupBy("term").agg(F.count("*").alias("n")).where(F.col("n") >= support).select("term"), "usable")

    term = F.explode(words_of(F.col("text"))).alias("term")
    rows = texts.select(term).groupBy("term").agg(F.count("*").alias("rows"))
    # A table of its own: without copies it is small, and no text is moved to meet it.
    again = texts.select("mark", "text").join(stored(copies.where("n > 1"), "again"), "mark").groupBy("mark", "n").agg(F.first("text").alias("text"))
    again = again.select("n", term).groupBy("term").agg(F.sum(F.col("n") - 1).alias("again"))
    terms = usable.join(rows, "term").join(again, "term", "left").select("term", (F.col("rows") - F.coalesce("again", F.lit(0))).alias("with_term"))
    terms = stored(terms, "terms")
    # both * total / (with_entity * with_term) must reach this; rounding may not rule out a pair.
    needed = F.pow(F.lit(float(total)) / F.col("with_entity"), F.lit(least)) * (1 - 1e-9)
    pairs = words.join(terms, "term").join(held, "mark").where(F.col("with_term") * needed <= float(total))
    both = pairs.groupBy("entity", "with_entity", "term", "with_term").agg(F.count("*").alias("both")).where(F.col("both") >= support)
    both = stored(both, "meetings")
    own = F.log2(F.lit(float(total)) / F.col("with_entity"))
    pmi = F.log2(F.col("both") * float(total) / (F.col("with_entity") * F.col("with_term")))
    scored = both.withColumn("disclosure", pmi / own)
    return scored.where(F.col("disclosure") >= least).select("entity", "term", "disclosure"), held.select("mark", "entity")


def sanitise(docs: DataFrame, text: str = "text", support: int = SUPPORT, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """``row`` (the other columns of ``docs``), ``text``, ``base`` and ``spans`` (s, k, e, kind, v), ``clean_text``; one row per input row.

    ``base`` holds the pattern spans by kind and start, ``spans`` those and then the terms'. A null text is empty and has
    none. In ``clean_text`` base spans are ``<kind>``, generalised terms ``<number>``, ``<name>`` or ``<word>``, and removed
    terms nothing. A term that overlaps a base span is left to that span. Exact copies are one text to the counts.
    """
    others = [F.col(f"`{c}`") for c in docs.columns if c != text]
    rows = docs.select(F.struct(*others).alias("row"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    spans = base_spans(F.col("text"))
    rows = rows.select("*", F.xxhash64("text").alias("mark"), F.concat(*[named(k, i, spans[k]) for i, k in enumerate(KINDS)]).alias("base"))
    # Only texts with entities can hold disclosing terms; the others are never moved.
    free = rows.where(F.size("base") == 0)
    rows = stored(rows.where(F.size("base") > 0), "entities")
    terms, held = disclosing_terms(rows.select("mark", "text", "base"), free.select("mark", "text"), support, generalise)
    told = held.join(terms, "entity").groupBy("mark", "term").agg(F.max("disclosure").alias("disclosure"))
    told = told.groupBy("mark").agg(F.collect_list(F.struct("term", "disclosure")).alias("terms"))
    rows = rows.join(told, "mark", "left")
    base = with_disclosure(F.col("base"), F.lit(None).cast("double"))
    # A column for each step: nested in one expression they are more than the analyzer's rounds resolve.
    rows = rows.withColumn("hits", F.when(F.col("terms").isNotNull(), term_spans(F.col("text"), F.col("terms"))))
    rows = rows.withColumn("both", F.sort_array(F.concat(base, "hits")))
    rows = rows.withColumn("clear", F.when(F.col("terms").isNotNull(), apart(F.col("both"), len(KINDS))))
    rows = rows.withColumn("spans", F.when(F.col("terms").isNull(), base).otherwise(F.concat(base, "clear")))
    rows = rows.withColumn("order", F.sort_array("spans"))

    def shown(x: Column) -> Column:
        kind = F.when(x["v"].rlike(r"\p{N}"), "<number>").when(x["v"].rlike(r"^\p{Lu}"), "<name>").otherwise("<word>")
        return F.when(x["kind"] != TERM, F.concat(F.lit("<"), x["kind"], F.lit(">"))).when(x["d"] >= remove, "").otherwise(kind)

    told = rows.select("row", "text", "base", "spans", replaced(F.col("text"), F.col("order"), shown).alias("clean_text"))
    told = told.withColumn("spans", F.transform("spans", lambda x: x.dropFields("d")))
    return told.union(free.select("row", "text", "base", F.col("base").alias("spans"), F.col("text").alias("clean_text")))


def digest(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts and digests of the spans that ``sanitise`` found."""
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return rows.select(
        F.col(f"row.{key}").alias(key),
        *[count(k) for k in KINDS],
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )
