"""Spans of regular expressions as native columns: start, end (exclusive, in code points) and text of every match."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<s:int,e:int,v:string>>"
# Items that are gone through in one fold, levels of such folds, and code points of the pieces that long texts are read in.
CHUNK, LEVELS, PIECE = 64, 2, 256


def none() -> Column:
    return F.array().cast(SPAN)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often it is named."""
    return F.transform(F.array(value), use)[0]


def before(values: Column, start: Column, add: Callable[[Column, Column], Column], kind: str = "int", levels: int = LEVELS) -> Column:
    """For each value the sum of those before it, under any associative ``add`` with neutral element ``start``.

    A fold copies what it has gathered at every step, so it only goes through chunks: chunks are summed, the sums before each
    chunk found in the same way, and each chunk is gone through from there.
    """

    def step(acc: Column, x: Column) -> Column:
        return F.struct(add(acc["sum"], x).alias("sum"), F.concat(acc["out"], F.array(acc["sum"])).alias("out"))

    def along(chunk: Column, first: Column) -> Column:
        return F.aggregate(chunk, F.struct(first.alias("sum"), F.array().cast(f"array<{kind}>").alias("out")), step, lambda acc: acc["out"])

    if levels == 0:
        return along(values, start)

    def cut(vs: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(vs) - 1) / CHUNK).cast("int")), lambda c: F.slice(vs, c * CHUNK + 1, CHUNK))

    def joined_up(chunks: Column) -> Column:
        sums = F.transform(chunks, lambda chunk: F.aggregate(chunk, start, lambda a, x: add(a, x)))
        return F.flatten(F.zip_with(chunks, before(sums, start, add, kind, levels - 1), along))

    return let(values, lambda vs: F.when(F.size(vs) > 0, let(cut(vs), joined_up)).otherwise(F.array().cast(f"array<{kind}>")))


def found(text: Column, pattern: str, keep: Callable[[Column], Column] | None = None, value: int = 0) -> Column:
    """Leftmost non-overlapping matches of a pattern, as an array of (s, e, v).

    ``v`` is the match, or its group ``value``. What ``keep`` of that value refuses is dropped and not tried again. Only texts
    with a match are taken apart: the pieces between matches, laid beside the matches, give the places.
    """
    parts = [F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit")]
    if value:
        parts.append(F.regexp_extract_all(text, F.lit(pattern), F.lit(value)).alias("val"))
    zipped = F.arrays_zip(*parts)

    width = lambda x: F.length(x["gap"]) + F.coalesce(F.length(x["hit"]), F.lit(0))

    def span(x: Column, at: Column) -> Column:
        s, v = at + F.length(x["gap"]), x["val"] if value else x["hit"]
        return F.struct(s.alias("s"), (s + F.length(x["hit"])).alias("e"), v.alias("v"))

    def placed(items: Column) -> Column:
        return F.zip_with(items, before(F.transform(items, width), F.lit(0), lambda a, x: a + x), span)

    # The last gap has no match after it.
    good = lambda x: x["e"].isNotNull() if keep is None else x["e"].isNotNull() & keep(x["v"])
    return F.when(text.rlike(pattern), F.filter(let(zipped, placed), good)).otherwise(none())


def named(kind: str, order: int, spans: Column) -> Column:
    """Spans with their kind and its place in the list of kinds."""
    return F.transform(
        spans, lambda x: F.struct(x["s"].alias("s"), F.lit(order).alias("k"), x["e"].alias("e"), F.lit(kind).alias("kind"), x["v"].alias("v"))
    )


def joined(spans: Column) -> Column:
    """``kind:start:end`` of the spans, joined by commas in their order."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")


def apart(spans: Column, k: int) -> Column:
    """Of spans sorted by start, then place of kind: those of kind number ``k``, the last one, that overlap no span of another
    kind."""
    own = lambda x: x["k"] == k

    def clear(xs: Column) -> Column:
        ends = F.transform(xs, lambda x: F.when(own(x), 0).otherwise(x["e"]))
        starts = F.transform(F.reverse(xs), lambda x: F.when(own(x), 2**31 - 1).otherwise(x["s"]))
        left = before(ends, F.lit(0), F.greatest)
        right = F.reverse(before(starts, F.lit(2**31 - 1), F.least))
        kept = F.zip_with(xs, left, lambda x, edge: F.when(own(x) & (x["s"] >= edge), x))
        return F.zip_with(kept, right, lambda x, edge: F.when(x["e"] <= edge, x))

    return F.filter(let(spans, clear), lambda x: x.isNotNull())


def replaced(text: Column, spans: Column, by: Callable[[Column], Column]) -> Column:
    """The text with each span replaced. Spans are sorted by start; one that overlaps an earlier one only extends it.

    Places in a text are found by counting from its start, so the text is cut once into pieces of equal length, and what lies
    between two spans is taken from the pieces that hold it.
    """

    def cut(pieces: Column, s: Column, e: Column) -> Column:
        first = F.floor(s / PIECE).cast("int")
        several = F.array_join(F.slice(pieces, first + 1, F.floor((e - 1) / PIECE).cast("int") - first + 1), "")
        return F.when(e > s, F.substring(several, s - first * PIECE + 1, e - s)).otherwise("")

    def told(xs: Column, pieces: Column) -> Column:
        ends = before(F.transform(xs, lambda x: x["e"]), F.lit(0), F.greatest)
        parts = F.zip_with(xs, ends, lambda x, at: F.when(x["s"] >= at, F.concat(cut(pieces, at, x["s"]), by(x))))
        last = F.array_max(F.transform(xs, lambda x: x["e"]))
        return F.concat(F.array_join(parts, ""), F.substring(text, last + 1, F.length(text)))

    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    return F.when(F.size(spans) > 0, let(spans, lambda xs: let(pieces, lambda ps: told(xs, ps)))).otherwise(text)
