"""SimHash near-duplicates: exact Hamming joins by vantage-point trees.

A document's fingerprint is the bitwise majority over the hashes of its word shingles. Equal fingerprints collapse to one
row. A tree of vantage points, built on the driver from a bounded sample, cuts the fingerprints into shards: at each node
a fingerprint lies inside (distance at most the median) or outside. A fingerprint belongs to one shard and also visits
every shard that the triangle bound does not rule out, so no link is lost whatever the sample was. It visits only shards
numbered below its own, since the two ends of a link need to meet once. A shard searches its own vantage-point tree the same way
and returns a forest of its links, never its pairs; alternating star steps join the forests of all shards.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, stored

SEED = 42
# Fingerprints that a shard owns on average; the number of shards follows the input.
SHARD_ROWS = 32768
# Rows the vantage points of the shard tree are chosen from.
SAMPLE = 16384
# Fingerprints that a leaf compares directly, and those compared with it at once.
LEAF, STRIP = 128, 8192
# Shingles whose bits are unpacked at once.
CHUNK = 1 << 16


def fingerprint(text: str | None, width: int = 4) -> int:
    """Signed 64-bit SimHash of a text; 0 if it has no word.

    A-Z are lower-cased, words are what white space of ASCII separates, a text of fewer than ``width`` words is one shingle.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    width = min(width, len(words))
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width))))
    hashes = b"".join(map(partial(xxhash.xxh64_digest, seed=SEED), shingles))
    n = len(hashes) // 8
    ones = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 8 * CHUNK):
        bits = np.unpackbits(np.frombuffer(hashes[start : start + 8 * CHUNK], np.uint8))
        ones += bits.reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


def with_fingerprint(docs: DataFrame, text: str = "text", width: int = 4, to: str = "fp") -> DataFrame:
    """All columns of ``docs`` and the fingerprint of its whole text; a null text has fingerprint 0."""

    @F.pandas_udf("long")
    def marks(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, width) for t in texts], dtype="int64")

    return docs.withColumn(to, marks(F.col(text)))


def distances(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def cut_at(d: np.ndarray) -> int | None:
    """Radius that leaves members on both sides, near the median; None if all lie at one distance."""
    middle = int(np.median(d))
    if (d > middle).any():
        return middle
    lower = d[d < middle]
    return int(lower.max()) if len(lower) else None


def shard_tree(sample: np.ndarray, depth: int) -> dict | None:
    """Vantage points and radii, ``depth`` levels deep at most; a leaf is None."""
    if depth == 0 or len(sample) < 2:
        return None
    d = distances(sample, sample[0])
    radius = cut_at(d)
    if radius is None:
        return None
    inside = d <= radius
    return {"at": sample[0], "radius": radius, "in": shard_tree(sample[inside], depth - 1), "out": shard_tree(sample[~inside], depth - 1)}


def route(fps: np.ndarray, tree: dict | None, reach: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Shard number, the fingerprints' indices that reach it and which of them it owns, in order of shard number."""
    number = 0
    stack = [(tree, np.arange(len(fps)), np.ones(len(fps), bool))]
    while stack:
        node, index, own = stack.pop()
        if node is None:
            yield number, index, own
            number += 1
            continue
        d = distances(fps[index], node["at"]).astype(int)
        inner, outer = d - reach <= node["radius"], d + reach > node["radius"]
        stack.append((node["out"], index[outer], own[outer] & (d[outer] > node["radius"])))
        stack.append((node["in"], index[inner], own[inner] & (d[inner] <= node["radius"])))


class Forest:
    """Union by smallest index."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        for x, y in zip(a.tolist(), b.tolist()):
            x, y = self.root(x), self.root(y)
            if x != y:
                self.up[max(x, y)] = min(x, y)


def link(fps: np.ndarray, members: np.ndarray, others: np.ndarray, reach: int) -> Forest:
    """Forest of all links among ``members`` and between them and ``others`` (indices into ``fps``)."""
    forest = Forest(len(fps))
    stack = [(members, np.concatenate([members, others]))]
    while stack:
        mine, asking = stack.pop()
        if not len(mine) or not len(asking):
            continue
        d = distances(fps[mine], fps[mine[0]]).astype(int)
        radius = cut_at(d) if len(mine) > LEAF else None
        if radius is None:
            for start in range(0, len(mine), LEAF):
                compare(forest, fps, mine[start : start + LEAF], asking, reach)
            continue
        e = distances(fps[asking], fps[mine[0]]).astype(int)
        stack.append((mine[d <= radius], asking[e - reach <= radius]))
        stack.append((mine[d > radius], asking[e + reach > radius]))
    return forest


def compare(forest: Forest, fps: np.ndarray, mine: np.ndarray, asking: np.ndarray, reach: int) -> None:
    """Compare a leaf with what asks it. Each asker joins its first hit; hits of one asker join one another."""
    for start in range(0, len(asking), STRIP):
        strip = asking[start : start + STRIP]
        near = np.bitwise_count(fps[strip][:, None] ^ fps[mine][None, :]) <= reach
        near &= strip[:, None] != mine[None, :]
        rows, cols = np.nonzero(near)
        if not len(rows):
            continue
        first = cols[np.searchsorted(rows, rows)]
        fresh = cols == first
        forest.join(strip[rows[fresh]], mine[cols[fresh]])
        both = np.unique(first[~fresh] * len(mine) + cols[~fresh])
        forest.join(mine[both // len(mine)], mine[both % len(mine)])


def links(fps: DataFrame, reach: int = 4) -> DataFrame:
    """Forest edges ``a``, ``b`` of the distinct fingerprints in column ``fp`` that differ in at most ``reach`` bits."""
    total = fps.count()
    depth = max(0, int(np.ceil(np.log2(max(1, total / SHARD_ROWS)))))
    drawn = [r[0] for r in fps.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()]
    tree = shard_tree(np.array(drawn, np.int64).view(np.uint64), depth)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = batch.column(0).to_numpy(zero_copy_only=False)
            owner = np.zeros(len(marks), int)
            dealt = list(route(marks.view(np.uint64), tree, reach))
            for shard, index, own in dealt:
                owner[index[own]] = shard
            for shard, index, own in dealt:
                keep = shard <= owner[index]
                columns = [np.full(keep.sum(), shard, np.int32), marks[index[keep]], own[keep]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["shard", "fp", "own"])

    def search(rows: pa.Table) -> pa.Table:
        marks = np.sort(rows.column("fp").to_numpy())
        owned = np.sort(rows.filter(rows.column("own")).column("fp").to_numpy())
        is_own = np.isin(marks, owned)
        forest = link(marks.view(np.uint64), np.flatnonzero(is_own), np.flatnonzero(~is_own), reach)
        roots = np.array([forest.root(i) for i in range(len(marks))], int)
        linked = np.flatnonzero(roots != np.arange(len(marks)))
        return pa.table({"a": marks[linked], "b": marks[roots[linked]]})

    dealt = fps.select("fp").mapInArrow(deal, "shard int, fp long, own boolean")
    return dealt.groupBy("shard").applyInArrow(search, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``root`` for every node of ``edges`` (a, b) but the roots; the root is a component's smallest node.

    Alternates large-star and small-star steps; each round is written to the shared folder. Rounds grow with the logarithm
    of the nodes. Degrees are never gathered: a step is a grouped minimum and a join.
    """
    found, mark = stored(edges.select("a", "b").distinct(), "edges"), None
    while True:
        both = found.union(found.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a != b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        joined = down.join(low, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(joined.select("a", F.col("m").alias("b")))
        found = stored(small.where("a != b").distinct(), "edges")
        now = found.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == mark:
            return found.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = now


def near_duplicates(docs: DataFrame, reach: int = 4, width: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``fp`` (signed long), ``component`` (smallest key of the linked documents), one row per input row.

    Null and empty texts have fingerprint 0 and link like any other. Repeated rows stay. Null keys are never a component's id
    unless all its keys are null. Other columns are left out, whatever their names.
    """
    marked = stored(with_fingerprint(docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")), "_text", width).select("_key", "fp"), "fingerprints")
    marks = stored(marked.groupBy("fp").agg(F.min("_key").alias("least")), "marks")
    roots = components(links(marks, reach))
    rooted = marks.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("least").alias("component"))
    named = stored(rooted.join(lowest, "root").select("fp", "component"), "named")
    return marked.join(named, "fp").select(F.col("_key").alias(key), "fp", "component")


def hex_mark(c: str | Column) -> Column:
    """16 lower-case hexadecimal digits of a fingerprint."""
    return F.lower(F.lpad(F.hex(c), 16, "0"))


def representatives(docs: DataFrame, reach: int = 4, width: int = 4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` without near copies: of each group the row with the smallest key (then fingerprint), once.

    Null keys come last. Of rows that share key and fingerprint one stays. Fingerprints and keys decide; whole rows are moved once, to
    meet the kept keys. Only rows that share a key are fingerprinted again, to tell them apart.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    packed = docs.select(F.struct(*columns).alias("row"), F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    marked = stored(with_fingerprint(packed.select("key", "text"), "text", width).select("key", "fp"), "marked")
    order = F.struct(F.col("key").isNull().alias("late"), F.col("key"), F.col("fp"))
    marks = stored(marked.groupBy("fp").agg(F.min(order).alias("least")), "marks")
    roots = components(links(marks, reach))
    rooted = marks.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("least", F.coalesce("root", "fp").alias("root"))
    firsts = rooted.groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.key").alias("one"), F.col("least.fp").alias("mark"))
    counts = marked.groupBy("key").agg(F.count("*").alias("n"))
    firsts = stored(firsts.join(counts, F.col("one").eqNullSafe(F.col("key"))).select("one", "mark", "n"), "firsts")
    alone, shared = firsts.where("n = 1").select("one"), firsts.where("n > 1")
    kept = packed.join(alone, F.col("key").eqNullSafe(F.col("one")), "left_semi").select("row")
    again = packed.join(stored(shared.select("one").distinct(), "shared"), F.col("key").eqNullSafe(F.col("one")), "left_semi")
    again = with_fingerprint(again, "text", width).join(shared, F.col("key").eqNullSafe(F.col("one")) & (F.col("fp") == F.col("mark")), "left_semi")
    again = again.groupBy("key", "fp").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return kept.union(again.select("row")).select("row.*")
