"""Approximate nearest neighbours by collision counting over query-centred windows.

Each of ``PROJECTIONS`` random directions gives a sorted array of the unit vectors' projections. A query opens a window
around its own projection in every array; a vector that lies in at least ``THRESHOLD`` of the windows is verified by its exact
cosine. Windows are widened step by step (virtual rehashing) and only the newly covered ends are counted. A query stops when its
k-th best verified distance is within the radius that the windows stand for; until then the windows grow, at last over the
whole arrays, so every query gets k neighbours if there are that many. Nothing caps the candidates.

Vectors are cut into shards of bounded size by a hash; queries meet every shard in blocks, and the best of all shards are
merged. Each vector is indexed; there is no sample.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PROJECTIONS = 64
# Collisions, of the projections, from which a vector is verified.
THRESHOLD = 37
# Factor by which the radius grows, and the first radius (distance of unit vectors).
GROWTH, FIRST = 1.2, 0.4
# Vectors of a shard and queries of a block, on average.
SHARD_ROWS, BLOCK_ROWS = 8192, 8192
# Queries whose windows are laid out at once.
STRIP = 256
# More than single precision can be off by in a cosine.
SLACK = 1e-4


def radii() -> np.ndarray:
    """Radii up to the largest distance of unit vectors, and one that covers the arrays."""
    steps = [FIRST]
    while steps[-1] < 2:
        steps.append(steps[-1] * GROWTH)
    return np.array([*steps, np.inf])


RADII = radii()


def directions(dims: int, seed: int = 11) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((PROJECTIONS, dims))


def cosines(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact cosines; a row's value does not depend on which rows stand beside it, so equal vectors tie exactly."""
    return (rows * query).sum(1) / (np.sqrt((rows * rows).sum(1)) * np.sqrt((query * query).sum()))


class Index:
    """Sorted projections of one shard."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.ids, self.rows = ids, rows
        self.axes = directions(rows.shape[1])
        self.unit = rows / np.sqrt((rows * rows).sum(1))[:, None]
        places = self.axes @ self.unit.T
        self.order = np.argsort(places, axis=1, kind="stable")
        self.places = np.take_along_axis(places, self.order, 1)
        self.unit = self.unit.astype(np.float32)

    def windows(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ends of each query's windows in every array, by radius: (query, radius, projection)."""
        at = (queries / np.sqrt((queries * queries).sum(1))[:, None]) @ self.axes.T
        shape = (len(queries), len(RADII), PROJECTIONS)
        low, high = np.empty(shape, np.int32), np.empty(shape, np.int32)
        for j, row in enumerate(self.places):
            low[:, :, j] = np.searchsorted(row, at[:, j, None] - RADII)
            high[:, :, j] = np.searchsorted(row, at[:, j, None] + RADII, "right")
        return low, high

    def nearest(self, ident: int, query: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The best ``k`` of this shard; ``low`` and ``high`` are the query's windows, (radius, projection)."""
        n = len(self.ids)
        hits = np.zeros(n, np.int64)
        checked = self.ids == ident
        ids, scores = np.empty(0, self.ids.dtype), np.empty(0)
        near = (query / np.sqrt((query * query).sum())).astype(np.float32)
        left = right = (low[0] + high[0]) // 2
        for radius, a, b in zip(RADII.tolist(), low, high):
            ends = zip(self.order, a.tolist(), left.tolist(), right.tolist(), b.tolist())
            hits += np.bincount(np.concatenate([x for o, a_, l_, r_, b_ in ends for x in (o[a_:l_], o[r_:b_])]), minlength=n)
            left, right = a, b
            fresh = np.flatnonzero((hits >= THRESHOLD) & ~checked)
            checked[fresh] = True
            rough = self.unit[fresh] @ near
            if len(ids) + len(fresh) > k:
                # Exact cosines for all that single precision cannot rule out.
                both = np.concatenate([rough, scores])
                fresh = fresh[rough >= np.partition(both, len(both) - k)[len(both) - k] - SLACK]
            ids = np.concatenate([ids, self.ids[fresh]])
            scores = np.concatenate([scores, cosines(self.rows[fresh], query)])
            best = np.lexsort((ids, -scores))[:k]
            ids, scores = ids[best], scores[best]
            if len(ids) == k and 2 - 2 * scores[-1] <= radius * radius:
                break
        return ids, scores


def usable(c: str) -> Column:
    """A vector without null, non-finite components, that is not all zero."""
    x = F.col(c)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce(~bad & F.exists(x, lambda v: v != 0), F.lit(False))


def search(vectors: DataFrame, asking: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` rows of largest cosine found for each row where ``asking`` holds.

    A row is no candidate for its own key. Ties go to the smaller key. Vectors that are null, empty, zero or hold null or
    non-finite components, and rows without key, take no part. Vectors are compared with those of their own length. If a
    key is repeated, each of its rows is a candidate, and its smallest vector asks. With fewer than ``k`` candidates all are returned.
    """
    clean = vectors.where(usable(vector) & F.col(key).isNotNull())
    rows = clean.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    ask = clean.where(asking).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    ask = ask.groupBy("id").agg(F.min("v").alias("v"))
    n, asked = rows.count(), ask.count()
    shards, blocks = max(1, -(-n // SHARD_ROWS)), max(1, -(-asked // BLOCK_ROWS))
    size = F.size("v").alias("dims")
    held = rows.select("id", "v", size, F.pmod(F.xxhash64("id", "v", F.lit(3)), F.lit(shards)).alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    posed = ask.select("id", "v", size, F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"))

    def run(queries: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
        columns = ["query_id", "vec_id", "score"]
        if queries.empty or part.empty:
            return pd.DataFrame(columns=columns).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
        index = Index(part["id"].to_numpy(), np.stack(part["v"].tolist()).astype(np.float64))
        out = []
        for start in range(0, len(queries), STRIP):
            idents = queries["id"].to_numpy()[start : start + STRIP]
            asked = np.stack(queries["v"].tolist()[start : start + STRIP]).astype(np.float64)
            for ident, v, low, high in zip(idents.tolist(), asked, *index.windows(asked)):
                ids, scores = index.nearest(ident, v, low, high, k)
                out.append(pd.DataFrame({"query_id": ident, "vec_id": ids, "score": scores}))
        return pd.concat(out, ignore_index=True)

    keys = ["dims", "shard", "block"]
    # As many partitions as shards: few bytes, but much work in each.
    held, posed = held.repartition(shards * blocks, *keys), posed.repartition(shards * blocks, *keys)
    found = posed.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInPandas(run, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
