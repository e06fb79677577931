"""Mixing sources to target weights by Pfair scheduling.

A source's rows are cut into blocks. Block j of a source of weight w is released at slot floor(j/w) and due by slot
ceil((j+1)/w); in each slot the released block with the earliest deadline is placed, so at every slot each source is less
than one block away from its share. Weights are taken exactly, as whole numbers over their common denominator.

The schedule is made on Spark, a segment of slots a task. How many blocks each source has had where a segment begins is found from
the weights alone: the share rounded down, or up for some sources. Those are chosen by an integral flow, so that in order of deadline
and in order of release each unit of the shares' fractions has one of them. Then too many late deadlines never come first and too many
early releases never wait, which is what a segment needs to be completed within all windows; earliest deadline first does it.
No block's window may hold a whole segment, so segments are longer than the window of the smallest weight.

Rows are numbered within a source by hash buckets: counts per bucket, their running sums, and a window inside each
bucket, so a source that holds a third of all rows is numbered by many tasks.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator, Mapping, Sequence
from fractions import Fraction

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored

# Parts that ``whole_parts`` rounds to; rows of a block; rows of a bucket on average.
PARTS, BLOCK, BUCKET_ROWS = 1000, 16, 4096
# Slots of a segment, and those for each source if that is more.
SLOTS, SLOTS_OF_SOURCE = 1 << 16, 8


def whole_parts(weights: Mapping[str, float], parts: int = PARTS) -> dict[str, int]:
    """Weights as whole parts of ``parts``. A source has one part at least, so the parts can add up to more.

    Largest remainders; equal ones go to the name that sorts first. Weights that are zero, negative or not finite are an error.
    """
    if not weights:
        return {}
    if not all(0 < w < float("inf") for w in weights.values()):
        raise ValueError("weights must be positive")
    total = sum(Fraction(w) for w in weights.values())
    exact = {s: Fraction(w) / total * parts for s, w in weights.items()}
    out = {s: int(x) for s, x in exact.items()}
    rest = sorted(exact, key=lambda s: (out[s] - exact[s], s))
    for s in rest[: parts - sum(out.values())]:
        out[s] += 1
    return {s: max(1, n) for s, n in out.items()}


def exact_parts(weights: Mapping[str, float]) -> dict[str, int]:
    """Whole numbers in exactly the ratio of the weights. Weights that are zero, negative or not finite are an error."""
    if not all(0 < w < float("inf") for w in weights.values()):
        raise ValueError("weights must be positive")
    exact = {s: Fraction(w) for s, w in weights.items()}
    scale = math.lcm(*(w.denominator for w in exact.values()))
    whole = {s: int(w * scale) for s, w in exact.items()}
    shared = math.gcd(*whole.values())
    return {s: n // shared for s, n in whole.items()}


def cells(order: Sequence[int], rest: Sequence[int], total: int) -> dict[int, list[int]]:
    """The one or two units of ``total`` in which each source's rest lies when the rests follow one another in ``order``."""
    out, sum_ = {}, 0
    for s in order:
        out[s] = sorted({sum_ // total, (sum_ + rest[s] - 1) // total})
        sum_ += rest[s]
    return out


def chosen(one: Mapping[int, list[int]], two: Mapping[int, list[int]], wanted: int) -> list[int]:
    """``wanted`` sources, one in each unit of either order, by augmenting paths along shortest layers (Dinic)."""
    # Nodes: start, units of the first order, sources going in and out, units of the second order, end.
    ends, room, out = [], [], {}

    def arc(a: object, b: object) -> None:
        for x, y, c in ((a, b, 1), (b, a, 0)):
            out.setdefault(x, []).append(len(ends))
            ends.append(y)
            room.append(c)

    for i in range(wanted):
        arc("start", (0, i))
        arc((3, i), "end")
    for s in sorted(one):
        for i in one[s]:
            arc((0, i), (1, s))
        arc((1, s), (2, s))
        for i in two[s]:
            arc((2, s), (3, i))
    flow = 0
    while flow < wanted:
        level, front = {"start": 0}, ["start"]
        while front and "end" not in level:
            after = []
            for x in front:
                for e in out[x]:
                    if room[e] and ends[e] not in level:
                        level[ends[e]] = level[x] + 1
                        after.append(ends[e])
            front = after
        if "end" not in level:
            raise AssertionError("no rounding found")
        at = dict.fromkeys(out, 0)
        path: list[int] = []
        here: object = "start"
        while True:
            if here == "end":
                for e in path:
                    room[e] -= 1
                    room[e ^ 1] += 1
                flow, path, here = flow + 1, [], "start"
            elif at[here] < len(out[here]):
                e = out[here][at[here]]
                if room[e] and level.get(ends[e]) == level[here] + 1:
                    path.append(e)
                    here = ends[e]
                else:
                    at[here] += 1
            elif path:
                here = ends[path.pop() ^ 1]
                at[here] += 1
            else:
                break
    return [s for s in sorted(one) for e in out[1, s] if ends[e] == (2, s) and not room[e]]


def carried(parts: Sequence[int], slot: int) -> list[int]:
    """Blocks of each source placed before ``slot``: its share rounded up or down, ``slot`` in all."""
    total = sum(parts)
    had, rest = [slot * p // total for p in parts], [slot * p % total for p in parts]
    open_ = [s for s, r in enumerate(rest) if r]
    by_due = sorted(open_, key=lambda s: (-(-(had[s] + 1) * total // parts[s]), s))
    by_release = sorted(open_, key=lambda s: (had[s] * total // parts[s], s))
    for s in chosen(cells(by_due, rest, total), cells(by_release, rest, total), slot - sum(had)):
        had[s] += 1
    return had


def segment(parts: Sequence[int], start: int, stop: int, last: bool) -> Iterator[tuple[int, int, int, int, int]]:
    """(source, block, slot, release, deadline) of the slots from ``start`` to ``stop``, earliest deadline first; ties by number.

    All but the last segment end with the counts that the next one begins with.
    """
    total = sum(parts)
    had = carried(parts, start)
    end = None if last else carried(parts, stop)
    waiting = [(j * total // parts[s], s, j) for s, j in enumerate(had) if end is None or j < end[s]]
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int, int, int]] = []
    for slot in range(start, stop):
        while waiting and waiting[0][0] <= slot:
            release, s, j = heapq.heappop(waiting)
            due = -(-(j + 1) * total // parts[s])
            heapq.heappush(ready, (due if last else min(due, stop), s, j, release, due))
        _, s, j, release, due = heapq.heappop(ready)
        yield s, j, slot, release, due
        if end is None or j + 1 < end[s]:
            heapq.heappush(waiting, ((j + 1) * total // parts[s], s, j + 1))


def period(parts: Mapping[str, int]) -> list[tuple[str, int, int, int, int]]:
    """(source, block, slot, release, deadline) of as many slots as there are parts; ties by name."""
    names = sorted(parts)
    found = segment([parts[s] for s in names], 0, sum(parts.values()), True)
    return [(names[s], j, slot, release, due) for s, j, slot, release, due in found]


def segment_length(parts: Sequence[int]) -> int:
    """Slots of a segment: more than any block's window has."""
    return max(SLOTS, SLOTS_OF_SOURCE * len(parts), -(-sum(parts) // min(parts)) + 2)


def schedule(spark: SparkSession, parts: Mapping[str, int], blocks: Mapping[str, int]) -> DataFrame:
    """``name``, ``block``, ``slot``, ``release``, ``deadline`` of the first ``blocks`` of each source."""
    names = sorted(parts)
    shares, needed, total = [parts[s] for s in names], [blocks[s] for s in names], sum(parts.values())
    slots = max((-(-n * total // p) for n, p in zip(needed, shares)), default=0)
    length = segment_length(shares)
    segments = -(-slots // length)

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in batch["id"].tolist():
                last = i == segments - 1
                found = segment(shares, i * length, slots if last else (i + 1) * length, last)
                rows = [(names[s], *told) for s, *told in found if told[0] < needed[s]]
                yield pd.DataFrame(rows, columns=["name", "block", "slot", "release", "deadline"])

    each = max(1, min(segments, 4 * spark.sparkContext.defaultParallelism))
    return spark.range(0, segments, 1, each).mapInPandas(made, "name string, block long, slot long, release long, deadline long")


def mix(docs: DataFrame, weights: Mapping[str, float] | None = None, source: str = "source", key: str = "doc_id", block: int = BLOCK, power: float = 0.5) -> DataFrame:
    """``row`` (all columns of ``docs``), ``block``, ``slot``, ``release``, ``deadline``, ``place`` (in the block); one row per input row.

    Ordered by slot and place the rows are the mixture. Nothing is dropped or repeated: when a source has no blocks left,
    its slots stay empty and the others keep their shares of the rest. Without ``weights``, a source's weight is its number of rows to
    the ``power``. A null source is a source of its own (``None`` in ``weights`` is not needed: sources without a weight share
    the smallest one). Within a source rows follow a hash of key and row; repeated rows stay. The sources and their weights are
    the mixture's recipe and are held by the driver and each segment's task; the schedule's blocks are not. Empty slots are gone
    through too, so weights far from the sources' sizes take time for all slots up to the last deadline.
    """
    name = F.coalesce(F.concat(F.lit("="), F.col(f"`{source}`").cast("string")), F.lit(""))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(F.struct(*columns).alias("row"), name.alias("name"), F.xxhash64(F.col(f"`{key}`"), *columns).alias("mark"))
    counts = {r["name"]: r["n"] for r in rows.groupBy("name").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    if weights is None:
        shares = {s: n**power for s, n in counts.items()}
    else:
        given = {f"={s}": w for s, w in weights.items()}
        shares = {s: given.get(s, min(given.values(), default=1.0)) for s in counts}
    buckets = max(1, -(-total // BUCKET_ROWS))
    rows = rows.withColumn("bucket", F.pmod("mark", F.lit(buckets)))
    sizes = stored(rows.groupBy("name", "bucket").agg(F.count("*").alias("n")), "sizes")
    before = F.sum("n").over(Window.partitionBy("name").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("name", "bucket", "n", F.coalesce(before, F.lit(0)).alias("start"))
    first, final = F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("n") - 1) / block)
    asked = starts.select("name", "bucket", "start", first.alias("first"), F.explode(F.sequence(first, final)).alias("block"))
    plan = schedule(docs.sparkSession, exact_parts(shares), {s: -(-n // block) for s, n in counts.items()}) if counts else None
    if plan is None:
        plan = asked.select("name", "block", *[F.lit(0).cast("long").alias(c) for c in ("slot", "release", "deadline")])
    times = asked.join(stored(plan, "plan"), ["name", "block"])
    times = times.groupBy("name", "bucket", "start", "first").agg(F.sort_array(F.collect_list(F.struct("block", "slot", "release", "deadline"))).alias("times"))
    inside = F.row_number().over(Window.partitionBy("name", "bucket").orderBy("mark")) - 1
    rows = rows.withColumn("inside", inside).join(times, ["name", "bucket"])
    number = F.col("start") + F.col("inside")
    rows = rows.withColumn("block", F.floor(number / block)).withColumn("place", (number % block).cast("int"))
    time = F.element_at("times", (F.col("block") - F.col("first") + 1).cast("int"))
    return rows.select("row", "block", *[time[c].alias(c) for c in ("slot", "release", "deadline")], "place")
