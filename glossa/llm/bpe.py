"""Byte-pair encoding with a segment tree over the ranks of adjacent pairs, and its decoding.

A pre-token is a row of byte symbols. The root of its tree is the leftmost pair of the lowest rank (``merges``); pairs merge until
none is left. The pre-tokens of a slice of texts that are not yet known are merged together, each once.

Encoding is row-local: no shuffle, and memory is bounded by one Arrow batch and a word memo of fixed size.
"""

from __future__ import annotations

import itertools
import json
import re
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .merges import Merges

# Fixed value: the public pre-token pattern of the byte-level vocabulary.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ANY = regex.compile(PRETOKEN).findall
# The same language on ASCII, where letters and digits are ranges.
ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+").findall
# Pre-tokens that a worker remembers; of more the older half goes, which changes no result.
MEMO = 1 << 20


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {b: chr(b) for b in printable}
    rest = (b for b in range(256) if b not in letters)
    return letters | {b: chr(256 + i) for i, b in enumerate(rest)}


class Codec:
    """Encoder and decoder of one vocabulary; ``memo`` maps a pre-token to its packed ids."""

    def __init__(self, spec: dict):
        self.memo: dict[str, bytes] = {}
        letters = byte_letters()
        raw = {c: b for b, c in letters.items()}
        vocab = spec["vocab"]
        self.first = np.array([vocab[letters[b]] for b in range(256)], np.int64)
        pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(spec["merges"]):
            pairs.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        self.merges = Merges(pairs)
        self.added = dict(spec["added"])
        named = {i: bytes(raw[c] for c in token) for token, i in vocab.items()}
        named |= {i: token.encode() for token, i in self.added.items()}
        self.pieces = pa.array([named.get(i, b"") for i in range(max(named) + 1)], pa.large_binary())
        longest_first = sorted(self.added, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")").split if self.added else None
        self.ids = {token: np.int32(i).tobytes() for token, i in self.added.items()}

    def pretokens(self, text: str) -> list[str]:
        """Pre-tokens of a text; added tokens stand for themselves."""
        find = ASCII if text.isascii() else ANY
        if self.cut is None or not any(t in text for t in self.added):
            return find(text)
        return [x for i, part in enumerate(self.cut(text)) for x in ([part] if i % 2 else find(part))]

    def learn(self, tokens: Iterable[str]) -> None:
        """Add the ids of pre-tokens, all merged together."""
        new = [t for t in tokens if t not in self.ids]
        self.memo.update((t, self.ids[t]) for t in tokens if t in self.ids)
        if not new:
            return
        data = list(map(str.encode, new))
        sizes = np.fromiter(map(len, data), np.int64, len(data))
        flat, sizes = self.merges.merge(self.first[np.frombuffer(b"".join(data), np.uint8)], sizes)
        packed, ends = flat.astype(np.int32).tobytes(), 4 * np.cumsum(sizes)
        self.memo.update(zip(new, (packed[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist()))))

    def encode(self, texts: Sequence[str]) -> list[bytes]:
        """Ids of each text, packed as 32-bit integers. Pre-tokens that are new are merged together, each once."""
        memo = self.memo
        if len(memo) > MEMO:
            for token in list(itertools.islice(memo, len(memo) - MEMO // 2)):
                del memo[token]
        found = list(map(self.pretokens, texts))
        self.learn(set().union(*found).difference(memo))
        return [b"".join(map(memo.__getitem__, tokens)) for tokens in found]

    def decode(self, ids: np.ndarray, offsets: Sequence[int]) -> list[bytes]:
        """Bytes of rows of ids that lie one after another: the taken pieces lie side by side, and one take serves all rows."""
        if not len(ids):
            return [b""] * (len(offsets) - 1)
        taken = self.pieces.take(pa.array(ids))
        ends = np.frombuffer(taken.buffers()[1], np.int64)[taken.offset : taken.offset + len(ids) + 1]
        data = taken.buffers()[2].to_pybytes()
        return [data[a:b] for a, b in itertools.pairwise(ends[np.asarray(offsets)].tolist())]


_codecs: dict[str, Codec] = {}


def load(path: str) -> dict:
    """The parts of a vocabulary file that the codec needs. Its size is the vocabulary's, whatever the corpus."""
    with open(path, encoding="utf-8") as file:
        whole = json.load(file)
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in whole["model"]["merges"]]
    added = [(t["content"], t["id"]) for t in whole["added_tokens"]]
    return {"vocab": whole["model"]["vocab"], "merges": merges, "added": added, "key": path}


def codec_of(spec: dict) -> Codec:
    """One codec per worker process and vocabulary; later tasks keep its memo."""
    if spec["key"] not in _codecs:
        _codecs[spec["key"]] = Codec(spec)
    return _codecs[spec["key"]]


def encode_decode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``ids`` array<int> and ``decoded`` string of every row's whole text.

    A null or empty text has no ids and decodes to the empty string. Rows are kept one to one: repeated rows and null keys
    stay, other columns are left out. Special tokens written out in a text are their single id, as in the library with its
    defaults. Ids that are no valid UTF-8 together decode with U+FFFD.
    """
    spec = docs.sparkSession.sparkContext.broadcast(load(path))
    rows = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(spec.value)
        for part in slices(batches):
            packed = codec.encode(part.column(1).to_pylist())
            offsets = [0, *itertools.accumulate(len(p) // 4 for p in packed)]
            flat = np.frombuffer(b"".join(packed), np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
            texts = [data.decode("utf-8", "replace") for data in codec.decode(flat, offsets)]
            yield pa.RecordBatch.from_arrays([part.column(0), ids, pa.array(texts, pa.string())], [key, "ids", "decoded"])

    kind = dict(rows.dtypes)[key]
    return rows.mapInArrow(run, f"`{key}` {kind}, ids array<int>, decoded string")


def digests(encoded: DataFrame, key: str = "doc_id") -> DataFrame:
    """Token count and digests of the ids and the decoded text."""
    return encoded.select(
        F.col(key),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
