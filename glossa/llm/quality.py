"""Quality rules: base counts of a text, and lines that too many documents of one host share.

Lines are normalised and hashed; the distinct documents that hold a line are counted per host. Lines of more than ``limit``
documents are removed, and a document that keeps less than ``least_left`` of its line characters is depleted. Exact
copies count as the documents they are.

Only built-in functions. Counting combines before its shuffle and shuffles hashes, never texts: the copies of a text are one row
with their number, and a line's documents are the sum of those.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, stored, text_of

BLANKS = r"[\x20\x09-\x0D]+"
# Fixed value: the characters that count as symbols.
SYMBOLS = "#*$%&|<>"
# Base rule: words a text needs, and the share of repeated words in percent that fails it.
LEAST_WORDS, MOST_REPEATED = 50, 50
# Documents of a host that may share a line, and the share of its line characters that a document must keep.
LINE_DOCS, LEAST_LEFT = 20, 0.3


def word_lines(text: Column) -> Column:
    """Lines that hold a word."""
    return F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")


def base_counts(rows: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of column ``text`` (null: none).

    A word is repeated if one of the three-word windows over it occurs twice or more in the text. Windows are compared by
    64-bit hashes: sorted with their places where a text has equal ones, so no pair of windows is formed.
    """
    text, gap = text_of(), F.col("_words")
    trimmed = F.btrim(text, F.lit(SPACES))
    out = rows.withColumn("_words", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANKS)))
    last = F.size(gap) - 3
    windows = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.get(gap, i), F.get(gap, i + 1), F.get(gap, i + 2)))
    out = out.withColumn("_windows", F.when(last >= 0, windows).otherwise(F.array().cast("array<bigint>"))).withColumn("n_words", F.size(gap).cast("long")).drop("_words")
    h = F.col("_windows")
    twice = F.size(F.array_distinct(h)) < F.size(h)
    out = out.withColumn("_sorted", F.when(twice, F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    s = F.col("_sorted")

    def again(x: Column, i: Column) -> Column:
        same = lambda j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
        return same(i - 1) | same(i + 1)

    out = out.withColumn("_places", F.sort_array(F.transform(F.filter(s, again), lambda x: x["i"])))
    p = F.col("_places")
    covered = F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3))))
    lines = F.col("_lines")
    return (
        out.withColumn("n_repeat_words", F.coalesce(F.aggregate(covered, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long"))
        .withColumn("word_chars", F.length(F.translate(text, SPACES, "")).cast("long"))
        .withColumn("n_symbols", (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"))
        .withColumn("_lines", word_lines(text))
        .withColumn("n_dup_lines", (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"))
        .drop("_windows", "_sorted", "_places", "_lines")
    )


def line_mark(line: Column) -> Column:
    """Hash of a line whose case, digits and blanks do not count."""
    return F.xxhash64(F.btrim(F.regexp_replace(F.regexp_replace(F.lower(line), "[0-9]+", "0"), BLANKS, " "), F.lit(SPACES)))


def marked_lines(text: Column) -> Column:
    """Distinct (mark, characters) of a text's lines."""
    return F.array_distinct(F.transform(word_lines(text), lambda x: F.struct(line_mark(x).alias("line"), F.length(x).alias("chars"))))


def frequent_lines(rows: DataFrame, limit: int = LINE_DOCS) -> DataFrame:
    """``host, mark, removed, lines`` of every text (by its hash) that holds lines of more than ``limit`` documents.

    ``rows`` has ``host`` and ``text``; each row is a document, repeated rows too. ``removed`` is in characters of the text's distinct lines; ``lines`` are the marks, at most as
    many as the text has lines.
    """
    marked = rows.select("host", F.xxhash64("text").alias("mark"), F.array_sort(marked_lines(F.col("text"))).alias("m"))
    # Of the lines of one text with one mark the longest stands for all, so that a row counts once.
    last = lambda x, i: ~F.coalesce(F.get("m", i + 1)["line"] == x["line"], F.lit(False))
    cut = marked.select("host", "mark", F.explode(F.filter("m", last)).alias("x"))
    # Copies of a text collapse here, before anything is joined.
    lines = cut.groupBy("host", "mark", F.col("x.line").alias("line")).agg(F.max("x.chars").alias("chars"), F.count("*").alias("copies"))
    lines = stored(lines, "lines")
    shared = lines.groupBy("host", "line").agg(F.sum("copies").alias("docs")).where(F.col("docs") > limit)
    hits = lines.join(shared, ["host", "line"])
    return hits.groupBy("host", "mark").agg(F.sum("chars").alias("removed"), F.collect_set("line").alias("lines"))


def quality(docs: DataFrame, host: str = "source", text: str = "text", limit: int = LINE_DOCS, least_left: float = LEAST_LEFT) -> DataFrame:
    """``row`` (all columns of ``docs``), base counts, ``base_failed``, ``left_share``, ``clean_text``, ``kept``; one row per input row.

    ``clean_text`` is the text without its frequent lines (blank lines stay). A null host is a host of its own; a null
    or wordless text has zero counts, fails the base rule and has no lines. A text is depleted if ``left_share`` is
    below ``least_left``; a document is kept if it passes the base rule and is not depleted.
    """
    host_key = F.coalesce(F.concat(F.lit("="), F.col(host).cast("string")), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), host_key.alias("host"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    bad = frequent_lines(rows.select("host", "text"), limit)
    whole = F.aggregate(marked_totals(F.col("text")), F.lit(0).cast("long"), lambda a, x: a + x)
    counted = base_counts(rows).withColumn("total", whole).withColumn("mark", F.xxhash64("text"))
    found = counted.join(bad, ["host", "mark"], "left")
    left = F.when(F.col("total") > 0, 1 - F.coalesce(F.col("removed"), F.lit(0)) / F.col("total")).otherwise(1.0)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    kept_lines = F.filter(F.split("text", "\n"), lambda x: ~F.array_contains("lines", line_mark(x)))
    return found.select(
        "row",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        left.alias("left_share"),
        F.when(F.col("lines").isNull(), F.col("text")).otherwise(F.array_join(kept_lines, "\n")).alias("clean_text"),
        (~failed & (left >= least_left)).alias("kept"),
    )


def marked_totals(text: Column) -> Column:
    """Characters of each distinct line, measured as in ``frequent_lines``: the longest of the lines with one mark."""
    marked = F.array_sort(marked_lines(text))
    # Sorted by mark, then length: the last of each run is the longest.
    merged = F.aggregate(
        marked,
        F.struct(F.lit(None).cast("long").alias("line"), F.lit(0).cast("long").alias("chars"), F.lit(0).cast("long").alias("sum")),
        lambda a, x: F.struct(
            x["line"].alias("line"),
            x["chars"].cast("long").alias("chars"),
            (a["sum"] + x["chars"] - F.when(a["line"] == x["line"], a["chars"]).otherwise(F.lit(0))).cast("long").alias("sum"),
        ),
        lambda a: F.array(a["sum"]),
    )
    return merged
