"""Ranked lexical search: term at a time, with a limited set of accumulators.

Documents are taken in segments, each with the posting lists of the terms that items ask for. An item's lists are added up from
the rarest term on, one accumulator per document met. New accumulators are made until what the terms still to come can give at
most is below the k-th best partial score; from then on only the documents met so far are updated, with all terms, so
their scores are exact and no document outside can reach the best k. Segments keep their best k of each item, which meet at the end.

Two passes over the documents, both row-local: one counts documents, terms and document frequencies, one ranks. Only counts and the
best k are shuffled. Items are asked in blocks of bounded text, so what each task holds does not grow with them.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, stored

# Text of the items that are asked together, in characters; documents and occurrences of a segment.
BLOCK_CHARS, SEGMENT_DOCS, SEGMENT_HITS = 1 << 21, 8192, 1 << 21
# The parts of a score.
WEIGHT, SCALE, FLAT, SLOPE = 1000, 1_000_000_000, 100, 75
# Terms are runs of these bytes of lower-cased UTF-8: digits, letters and all that is not ASCII.
TERMS = re.compile(rb"[0-9a-z\x80-\xff]+").findall


def terms_of(text: str | None) -> list[bytes]:
    """Terms of a text in order; only A-Z are lower-cased."""
    return TERMS(text.encode().lower()) if text else []


def weight(df: int, total: int) -> int:
    return math.floor(WEIGHT * math.log((2 * total + 2) / (2 * df + 1)))


class Segment:
    """Posting lists of some documents: per term the documents that hold it and the unweighted part of their scores."""

    def __init__(self, keys: list, sizes: list[int], hits: list[np.ndarray], total: int, length: int):
        n = np.array(sizes, np.int64)
        owner = np.repeat(np.arange(len(sizes)), [len(h) for h in hits])
        both, tf = np.unique(np.concatenate(hits).astype(np.int64) << 32 | owner, return_counts=True)
        self.keys, self.members = keys, both & 0xFFFFFFFF
        dull = FLAT - SLOPE + (SLOPE * n * total) // length
        self.parts = (SCALE * tf) // (1000 * tf + 8 * dull[self.members])
        terms, starts = np.unique(both >> 32, return_index=True)
        ends = [*starts[1:].tolist(), len(both)]
        most = np.maximum.reduceat(self.parts, starts).tolist() if len(starts) else []
        self.lists = dict(zip(terms.tolist(), zip(starts.tolist(), ends, most)))

    def best(self, asked: Sequence[tuple[int, int]], k: int, floor: int) -> list[tuple[int, int]]:
        """(score, document's place) of documents that can be among the best ``k``; ties with the k-th are all there.

        ``asked`` has (term, weight times repeats) from the rarest on; no score below ``floor`` is wanted.
        """
        lists = [(*self.lists[term], w) for term, w in asked if w and term in self.lists]
        ahead = sum(most * w for _, _, most, w in lists)
        sums, behind, growing = np.zeros(len(self.keys), np.int64), 0, True
        for start, end, most, w in lists:
            at, gain = self.members[start:end], w * self.parts[start:end]
            if not growing:
                known = sums[at] > 0
                at, gain = at[known], gain[known]
            sums[at] += gain
            ahead, behind = ahead - most * w, behind + most * w
            # No partial score is above ``behind``, so the k-th need not be looked up while that is too low.
            if growing and ahead < max(behind, floor):
                growing = ahead >= max(floor, kth(sums, k))
        least = max(1, floor, kth(sums, k))
        found = np.flatnonzero(sums >= least)
        return list(zip(sums[found].tolist(), found.tolist()))


def kth(scores: np.ndarray, k: int) -> int:
    """The k-th largest score, 0 if there are fewer."""
    return int(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else 0


def order(row: tuple[int, Any]) -> tuple:
    """Best score first, then the smaller key; a null key comes last."""
    return -row[0], row[1] is None, row[1]


def ask(docs: DataFrame, items: list[tuple[Any, Counter]], kind: str, k: int, key: str, text: str) -> DataFrame:
    """``item_id, key, score`` of each task's best documents for a block of items."""
    spark = docs.sparkSession
    number = {t: i + 1 for i, t in enumerate(sorted({t for _, terms in items for t in terms}))}
    shared = spark.sparkContext.broadcast(number)
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, docs_, length = np.zeros(len(shared.value) + 1, np.int64), 0, 0
        for part in slices(batches):
            for value in part.column(1).to_pylist():
                words = terms_of(value)
                docs_, length = docs_ + bool(words), length + len(words)
                held[list(filter(None, map(shared.value.get, set(words))))] += 1
        some = np.flatnonzero(held)
        columns = [np.append(some, [-1, -2]), np.append(held[some], [docs_, length])]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["term", "n"])

    counts = rows.mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    df = {r.term: r.n for r in counts.collect()}
    total, length = df.get(-1, 0), df.get(-2, 0)
    value = {i: weight(df[i], total) for i in number.values() if i in df}
    rarest = lambda terms: sorted((df[number[t]], number[t], n) for t, n in terms.items() if number[t] in df)
    asked = spark.sparkContext.broadcast([[(i, value[i] * n) for _, i, n in rarest(terms)] for _, terms in items])
    names = spark.sparkContext.broadcast([ident for ident, _ in items])

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[int, Any]]] = [[] for _ in asked.value]

        def close() -> None:
            segment = Segment(keys, sizes, hits, total, length)
            for i, terms in enumerate(asked.value):
                floor = best[i][-1][0] if len(best[i]) == k else 0
                fresh = [(score, keys[at]) for score, at in segment.best(terms, k, floor)]
                if fresh:
                    best[i] = heapq.nsmallest(k, [*best[i], *fresh], key=order)

        keys, sizes, hits, held, like = [], [], [], 0, None
        for part in slices(batches):
            like = part.schema
            for ident, value in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                words = terms_of(value)
                mine = np.array(list(filter(None, map(shared.value.get, words))), np.int32)
                if len(mine):
                    keys.append(ident)
                    sizes.append(len(words))
                    hits.append(mine)
                    held += len(mine)
                if len(keys) >= SEGMENT_DOCS or held >= SEGMENT_HITS:
                    close()
                    keys, sizes, hits, held = [], [], [], 0
        if keys:
            close()
        if like is not None:
            rows = [(names.value[i], ident, score) for i, found in enumerate(best) for score, ident in found]
            columns = list(zip(*rows)) if rows else [(), (), ()]
            types = [pa.string() if kind == "string" else None, like.field(0).type, pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t or pa.int64()) for c, t in zip(columns, types)], ["item_id", "key", "score"])

    return rows.mapInArrow(rank, f"item_id {kind}, key {dict(rows.dtypes)['key']}, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 10, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """``item, rank, key, score``: the ``k`` documents of highest score above 0 for each item (all, if fewer).

    Equal scores go to the smaller key, null keys last. Each row of ``docs`` is a document, repeated rows too; a null text has no
    terms and counts for nothing. Rows that share an item id are one item with the terms of all their different texts;
    items without a known term have no rows. Item ids are whole numbers or strings. Other columns are left out, whatever their names.
    """
    kind = dict(items.dtypes)[item]
    kind = kind if kind == "string" else "bigint"
    texts = items.select(F.col(f"`{item}`").cast(kind).alias("item"), F.col(f"`{item_text}`").alias("text")).where("text is not null").distinct()
    texts = stored(texts, "items")
    blocks = max(1, -(-(texts.agg(F.sum(F.length("text"))).first()[0] or 0) // BLOCK_CHARS))
    found = None
    for block in range(blocks):
        terms: dict[Any, Counter] = {}
        for ident, value in texts.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).collect():
            terms.setdefault(ident, Counter()).update(terms_of(value))
        part = ask(docs, [x for x in terms.items() if x[1]], kind, k, key, text)
        found = part if found is None else found.union(part)
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("key")))
    best = found.withColumn("rank", place).where(F.col("rank") <= k)
    return best.select(F.col("item_id").alias(item), "rank", F.col("key").alias(key), "score")
