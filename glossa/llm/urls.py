"""URL rules in a sorted digest array.

A rule is a host and a path prefix, written together. Its 64-bit xxhash goes into a sorted array that tasks memory-map; the rule
strings lie beside it. A URL asks with every suffix of its host and every length of path that some rule has; all questions of a
batch are answered by one vectorised binary search, and a hit counts only if the stored string is the same, so digests
that collide do no harm. The longest rule wins.

The rules are a list of the caller's, with a checked bound; Spark hands the files to the executors. URLs are judged
row by row, without a shuffle.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices

ALLOW, BLOCK = "allow", "block"
# Bytes of rules that one index may hold; more is an error.
MOST_BYTES = 256 << 20


def host(url: str = "url") -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    found = F.regexp_extract(_rest(url), r"^([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: str = "url") -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: str) -> Column:
    at = F.instr(F.col(url), "://")
    return F.when(at > 0, F.substring(F.col(url), at + 3, F.length(F.col(url)))).otherwise("")


class Rules:
    """Memory-mapped index."""

    def __init__(self, folder_of, name: str):
        part = lambda kind: folder_of(f"{name}-{kind}.npy")
        self.digests = np.load(part("digests"), mmap_mode="r")
        self.offsets = np.load(part("offsets"), mmap_mode="r")
        self.bytes = np.load(part("bytes"), mmap_mode="r")
        self.blocks = np.load(part("blocks"), mmap_mode="r")
        self.lengths = np.load(part("lengths")).tolist()

    def string(self, i: int) -> bytes:
        return self.bytes[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def judge(self, hosts: list[str], paths: list[str]) -> tuple[list[str | None], list[bool]]:
        """Longest rule of each URL, and whether it blocks."""
        asked: list[bytes] = []
        owner: list[int] = []
        for i, (name, way) in enumerate(zip(hosts, paths)):
            heads = [way[:n].encode() for n in self.lengths if n <= len(way)]
            at = 0
            while name and at >= 0:
                suffix = name[at:].encode()
                asked += [suffix + head for head in heads]
                owner += [i] * len(heads)
                at = name.find(".", at) + 1 or -1
        rules: list[str | None] = [None] * len(hosts)
        blocked = [False] * len(hosts)
        if not asked or not len(self.digests):
            return rules, blocked
        keys = np.fromiter(map(xxhash.xxh64_intdigest, asked), np.uint64, len(asked))
        low, high = np.searchsorted(self.digests, keys), np.searchsorted(self.digests, keys, "right")
        best: dict[int, tuple] = {}
        for n in np.flatnonzero(low < high).tolist():
            for r in range(low[n], high[n]):
                if self.string(r) == asked[n]:
                    rule = asked[n].decode()
                    rank = (len(rule), len(rule.split("/", 1)[0]))
                    if rank > best.get(owner[n], ((-1, -1),))[0]:
                        best[owner[n]] = (rank, rule, bool(self.blocks[r]))
        for i, (_, rule, blocks) in best.items():
            rules[i], blocked[i] = rule, blocks
        return rules, blocked


def build(spark: SparkSession, rules: Sequence[tuple[str, str]]) -> str:
    """Write the index of (rule, verdict) and hand it to the executors; returns its name.

    A rule listed with both verdicts blocks. Raises for another verdict, or if the rules take more than ``MOST_BYTES``.
    """
    merged: dict[bytes, bool] = {}
    for rule, verdict in rules:
        if verdict not in (ALLOW, BLOCK):
            raise ValueError(f"verdict of {rule} is {verdict}")
        name, slash, way = rule.partition("/")
        key = (name.lower() + slash + way).encode()
        merged[key] = merged.get(key, False) or verdict == BLOCK
    if sum(map(len, merged)) > MOST_BYTES:
        raise ValueError(f"rules take more than {MOST_BYTES} bytes")
    order = sorted((xxhash.xxh64_intdigest(key), key) for key in merged)
    strings = [key for _, key in order]
    paths = [s.decode().partition("/") for s in strings]
    arrays = {
        "digests": np.array([d for d, _ in order], np.uint64),
        "offsets": np.cumsum([0, *map(len, strings)], dtype=np.int64),
        "bytes": np.frombuffer(b"".join(strings), np.uint8),
        "blocks": np.array([merged[s] for s in strings], bool),
        "lengths": np.array(sorted({len(slash + way) for _, slash, way in paths}), np.int64),
    }
    name = f"rules-{uuid.uuid4().hex}"
    stage = os.path.join(SparkFiles.getRootDirectory(), f"stage-{name}")
    os.makedirs(stage)
    for kind, array in arrays.items():
        file = os.path.join(stage, f"{name}-{kind}.npy")
        np.save(file, array)
        spark.sparkContext.addFile(file)
    return name


_open: dict[str, Rules] = {}


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]], key: str = "page_id", url: str = "url", otherwise: str = ALLOW) -> DataFrame:
    """``key, host, path, rule, verdict`` of every URL; one row per input row.

    A rule fits its host and all subdomains if the path starts with the rule's; the longest fits best, of equally long ones that
    with the longer host. Without a rule, ``rule`` is null and the verdict ``otherwise``. A null or empty URL, or one without
    ``://``, has an empty host and path and fits no rule. Other columns are left out, whatever their names.
    """
    name = build(pages.sparkSession, rules)
    rows = pages.select(F.col(key), F.coalesce(F.col(url), F.lit("")).alias("_url"))
    rows = rows.select(F.col(key), host("_url").alias("host"), path("_url").alias("path"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _open:
            _open[name] = Rules(SparkFiles.get, name)
        index = _open[name]
        for part in slices(batches):
            found, blocked = index.judge(part.column(1).to_pylist(), part.column(2).to_pylist())
            verdicts = [otherwise if r is None else BLOCK if b else ALLOW for r, b in zip(found, blocked)]
            columns = [*part.columns, pa.array(found, pa.string()), pa.array(verdicts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [key, "host", "path", "rule", "verdict"])

    return rows.mapInArrow(run, f"`{key}` {dict(rows.dtypes)[key]}, host string, path string, rule string, verdict string")
