"""SentencePiece encoding that keeps the place of every piece in the original text, and decoding.

A text is normalised by its longest prefixes in the model's compiled character map, each rewritten as the map says; a character
without an entry stays. Every character that comes out keeps the byte at which its prefix began, so the pieces, which are runs
of normalised characters, project to byte spans of the original text. Pieces come from merging adjacent symbols, the
merge of the best score first (``merges``). A character that the model lacks becomes its bytes.

Normalised text is cut where no piece can reach across: around characters that stand in no longer piece, and before a
space mark if no piece has one after another character. Parts that are new to a worker are merged together, each once.
Encoding is row-local: no shuffle, and memory is bounded by one Arrow batch and a memo of fixed size.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .merges import Merges

# Fixed values of the model format: kinds of pieces, the space mark, and what stands for a byte that is no text.
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
MARK, BROKEN = "▁", "\ufffd"
# Parts that a worker remembers; of more the older half goes, which changes no result.
MEMO = 1 << 20


def _number(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value, shift, at = value | (byte & 0x7F) << shift, shift + 7, at + 1
        if byte < 0x80:
            return value, at


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of one message of the model file."""
    at = 0
    while at < len(data):
        tag, at = _number(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _number(data, at)
        else:
            size = {1: 8, 5: 4}.get(kind)
            if size is None:
                size, at = _number(data, at)
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


def parse(data: bytes) -> dict:
    """The parts of a model that encoding and decoding need. Its size is the vocabulary's, whatever the corpus."""
    pieces, trainer, normalizer = [], {}, {}
    for number, value in fields(data):
        if number == 1:
            piece = dict(fields(value))
            score = float(np.frombuffer(piece.get(2, bytes(4)), "<f4")[0])
            pieces.append((piece[1].decode(), score, piece.get(3, NORMAL)))
        elif number == 2:
            trainer |= dict(fields(value))
        elif number == 3:
            normalizer |= dict(fields(value))
    if trainer.get(3, 1) != 2 or any(kind not in (NORMAL, UNKNOWN, CONTROL, BYTE) for _, _, kind in pieces):
        raise ValueError("only pair models without user-defined or unused pieces are supported")
    if trainer.get(24, 0):
        raise ValueError("space marks after words are not supported")
    return {
        "pieces": pieces,
        "bytes": bool(trainer.get(35, 0)),
        "end": trainer.get(42, 2),
        "unknown": bytes(trainer.get(44, b" \xe2\x81\x87 ")),
        "map": bytes(normalizer.get(2, b"")),
        "prefix": bool(normalizer.get(3, 1)),
        "trim": bool(normalizer.get(4, 1)),
        "mark": bool(normalizer.get(5, 1)),
    }


def load(path: str) -> dict:
    with open(path, "rb") as file:
        return parse(file.read()) | {"key": path}


class CharMap:
    """A compiled character map: a double-array trie of prefixes, each leading to a text in a table of texts."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
        self.texts = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes | None]:
        """Length of the longest prefix of ``data`` from ``at`` on that the map holds, and what it becomes; 0 if none."""
        if not self.units:
            return 0, None
        units, length, found = self.units, 0, -1
        # A unit's bits: 0-7 label, 8 whether a value follows, 9 scale of the offset, 10-30 offset; 31 marks a value.
        unit = units[0]
        node = (unit >> 10) << ((unit >> 6) & 8)
        for i in range(at, len(data)):
            node ^= data[i]
            unit = units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= (unit >> 10) << ((unit >> 6) & 8)
            if unit >> 8 & 1:
                length, found = i + 1 - at, units[node] & 0x7FFFFFFF
        return (length, self.texts[found : self.texts.index(b"\0", found)]) if length else (0, None)


class Pieces:
    """Encoder and decoder of one model; ``memo`` maps a part of normalised text to its packed ids."""

    def __init__(self, spec: dict):
        self.spec, self.map = spec, CharMap(spec["map"])
        self.memo: dict[str, bytes] = {}
        pieces = spec["pieces"]
        self.vocab = {p: i for i, (p, _, kind) in enumerate(pieces) if kind == NORMAL}
        unknown = next((i for i, x in enumerate(pieces) if x[2] == UNKNOWN), 0)
        self.bytes = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == BYTE} if spec["bytes"] else {}
        # Symbols are ids of pieces, or numbers above them for characters without one.
        self.size, self.unknown = len(pieces), unknown
        chars = {c for p in self.vocab for c in p}
        self.symbol = {c: self.vocab.get(c, self.size + i) for i, c in enumerate(sorted(chars))}
        self.other = {v: c for c, v in self.symbol.items() if v >= self.size}
        ranks = {s: r for r, s in enumerate(sorted({-pieces[i][1] for i in self.vocab.values()}))}
        pairs = {}
        for p, i in self.vocab.items():
            for cut in range(1, len(p)):
                a, b = p[:cut], p[cut:]
                a = self.symbol.get(a) if cut == 1 else self.vocab.get(a)
                b = self.symbol.get(b) if cut == len(p) - 1 else self.vocab.get(b)
                if a is not None and b is not None:
                    pairs[a, b] = ranks[-pieces[i][1]], i
        self.merges = Merges(pairs)
        inner = {c for p in self.vocab if len(p) > 1 for c in p} - {MARK}
        joined = "[" + "".join(map(re.escape, sorted(inner))) + "]" if inner else r"(?!)"
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in self.vocab):
            joined = f"[{MARK}{joined[1:]}"
        self.parts = re.compile(f"{MARK}*{joined}+|{MARK}+|.", re.DOTALL).findall
        # For spans: normalised characters of a piece; bytes count at the last one of a character.
        self.chars = np.array([len(p) if kind != BYTE else 0 for p, _, kind in pieces], np.int64)
        self.is_byte, self.follows = np.zeros(self.size, bool), np.zeros(self.size, bool)
        for byte, i in self.bytes.items():
            self.is_byte[i], self.follows[i] = True, 0x80 <= byte < 0xC0
        shown = [self._shown(i, p, kind) for i, (p, _, kind) in enumerate(pieces)]
        self.shown = pa.array(shown, pa.large_binary())
        self.leading = np.array([p.startswith(MARK) and kind == NORMAL for p, _, kind in pieces])

    def _shown(self, i: int, piece: str, kind: int) -> bytes:
        if kind == CONTROL:
            return b""
        if kind == UNKNOWN:
            return self.spec["unknown"]
        return bytes([int(piece[3:5], 16)]) if kind == BYTE else piece.replace(MARK, " ").encode()

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """Normalised text, and for each of its characters and its end the byte of the original where it came from."""
        data, spec = text.encode(), self.spec
        out: list[str] = []
        origin: list[int] = []
        at, blank = 0, spec["trim"]
        while at < len(data):
            length, new = self.map.longest(data, at)
            if not length:
                first = data[at]
                length = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
                new = data[at : at + length]
            fresh = new.decode()
            if blank:
                fresh = fresh.lstrip(" ")
            if fresh:
                out.append(fresh)
                origin += [at] * len(fresh)
                blank = spec["trim"] and fresh.endswith(" ")
            at += length
        space = MARK if spec["mark"] else " "
        whole, end = "".join(out).replace(" ", space), len(data)
        # With trimming the prefix stands where the text begins, after the blanks that are dropped.
        head = self._blanks(data) if spec["trim"] else 0
        if spec["prefix"] and head < len(data):
            whole, origin = space + whole, [head, *origin]
        if spec["trim"]:
            kept = len(whole.rstrip(space))
            end = origin[kept] if kept < len(whole) else end
            whole, origin = whole[:kept], origin[:kept]
        return whole, np.array([*origin, end], np.int64)

    def _blanks(self, data: bytes) -> int:
        at = 0
        while at < len(data):
            length, new = self.map.longest(data, at)
            if (new if length else data[at : at + 1]) != b" ":
                break
            at += length or 1
        return at

    def normalised(self, texts: Sequence[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Normalised texts; the origins of all their characters, end to end; and the bytes of each text."""
        spec = self.spec
        if self.map.units or spec["trim"] or not spec["mark"]:
            both = [self.normalise(t) for t in texts]
            origins = np.concatenate([o[:-1] for _, o in both]) if both else np.zeros(0, np.int64)
            return [t for t, _ in both], origins, np.array([o[-1] for _, o in both], np.int64)
        # Nothing is rewritten: a character's origin is the sum of the bytes before it.
        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        width = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
        counts = np.fromiter(map(len, texts), np.int64, len(texts))
        begin = np.cumsum(width) - width
        ends = np.append(begin, width.sum())[np.cumsum(counts)] if len(texts) else counts
        sizes = np.diff(ends, prepend=0)
        origins = begin - np.repeat(ends - sizes, counts)
        if spec["prefix"]:
            origins = np.insert(origins, (np.cumsum(counts) - counts)[counts > 0], 0)
        head = MARK if spec["prefix"] else ""
        return [head + t.replace(" ", MARK) if t else "" for t in texts], origins, sizes

    def learn(self, parts: Iterable[str]) -> None:
        """Add the ids of parts of normalised text, all merged together."""
        new = list(parts)
        if not new:
            return
        symbol, fresh = self.symbol, {}
        flat = np.array([symbol[c] if c in symbol else fresh.setdefault(c, self.size + len(symbol) + len(fresh)) for part in new for c in part], np.int64)
        flat, sizes = self.merges.merge(flat, np.fromiter(map(len, new), np.int64, len(new)))
        ids = flat.tolist()
        odd = {v: c for c, v in fresh.items()} | self.other
        ends = np.cumsum(sizes).tolist()
        for part, start, end in zip(new, [0, *ends], ends):
            mine = ids[start:end]
            if max(mine) >= self.size:
                mine = [x for i in mine for x in (self._spelled(odd[i]) if i >= self.size else (i,))]
            self.memo[part] = np.array(mine, np.int32).tobytes()

    def _spelled(self, char: str) -> list[int]:
        return [self.bytes[b] for b in char.encode()] if self.bytes else [self.unknown]

    def encode(self, texts: Sequence[str]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Packed ids of each text, and the byte spans of all pieces end to end.

        Of a character spelled in bytes the last piece has the span, the others an empty one at its start. Without bytes, unknown
        characters that follow one another are one unknown piece.
        """
        memo = self.memo
        if len(memo) > MEMO:
            for part in list(itertools.islice(memo, len(memo) - MEMO // 2)):
                del memo[part]
        clean, origins, sizes = self.normalised(texts)
        found = list(map(self.parts, clean))
        self.learn(set().union(*found).difference(memo))
        packed = [b"".join(map(memo.__getitem__, parts)) for parts in found]
        counts = np.fromiter((len(p) // 4 for p in packed), np.int64, len(packed))
        ids = np.frombuffer(b"".join(packed), np.int32)
        chars = np.where(ids == self.unknown, 1, self.chars[ids])
        following = np.append(self.follows[ids[1:]], False) if len(ids) else np.zeros(0, bool)
        chars[self.is_byte[ids] & ~following] = 1
        ends = np.cumsum(chars)
        # Where a piece ends in the original: at the origin of the next character, or the end of its text.
        lengths = np.fromiter(map(len, clean), np.int64, len(clean))
        last = np.cumsum(lengths)
        owner = np.repeat(np.arange(len(texts)), counts)
        starts = np.append(origins, 0)[ends - chars]
        stops = np.where(ends == last[owner], sizes[owner], np.append(origins, 0)[np.minimum(ends, len(origins))])
        stops = np.where(chars == 0, starts, stops)
        if not self.bytes and len(ids):
            packed, starts, stops = self._runs(ids, owner, starts, stops, len(texts))
        return packed, starts, stops

    def _runs(self, ids: np.ndarray, owner: np.ndarray, starts: np.ndarray, stops: np.ndarray, n: int) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        same = np.append(False, (ids[1:] == self.unknown) & (ids[:-1] == self.unknown) & (owner[1:] == owner[:-1]))
        final = np.append(~same[1:], True)
        begins = np.flatnonzero(~same)
        ends = np.searchsorted(owner[begins], np.arange(n + 1))
        return [ids[begins[a:b]].tobytes() for a, b in itertools.pairwise(ends.tolist())], starts[begins], stops[final]

    def decode(self, ids: np.ndarray, offsets: Sequence[int]) -> list[str]:
        """Texts of rows of ids that lie one after another. The space that the prefix put at the start goes."""
        if not len(ids):
            return [""] * (len(offsets) - 1)
        taken = self.shown.take(pa.array(ids))
        ends = np.frombuffer(taken.buffers()[1], np.int64)[taken.offset : taken.offset + len(ids) + 1]
        data = taken.buffers()[2].to_pybytes() if taken.buffers()[2] else b""
        places = ends[np.asarray(offsets)].tolist()
        visible = ends[1:] > ends[:-1]
        # The first piece of each row that shows anything.
        marks = np.append(np.flatnonzero(visible), len(ids))
        first = marks[np.searchsorted(marks, np.asarray(offsets)[:-1])]
        opened = self.leading[ids[np.minimum(first, len(ids) - 1)]] & (first < np.asarray(offsets)[1:])
        out = []
        for a, b, strip in zip(places, places[1:], opened.tolist()):
            row = data[a:b]
            if strip and self.spec["prefix"]:
                row = row[1:]
            elif strip and self.spec["trim"]:
                row = row.lstrip(b" ")
            try:
                out.append(row.decode())
            except UnicodeDecodeError:
                out.append(readable(row))
        return out


def readable(data: bytes) -> str:
    """Text of bytes of which some are no text: each such byte is U+FFFD by itself."""
    out, at = [], 0
    while at < len(data):
        first = data[at]
        length = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
        try:
            out.append(data[at : at + length].decode())
            at += length
        except UnicodeDecodeError:
            out.append(BROKEN)
            at += 1
    return "".join(out)


_models: dict[str, Pieces] = {}


def model_of(spec: dict) -> Pieces:
    """One model per worker process and file; later tasks keep its memo."""
    if spec["key"] not in _models:
        _models[spec["key"]] = Pieces(spec)
    return _models[spec["key"]]


def encode_decode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", end: bool = True) -> DataFrame:
    """``key``, ``ids``, ``starts`` and ``stops`` (arrays of int), ``decoded`` string of every row's whole text.

    ``starts`` and ``stops`` are the bytes of the original text that each piece stands for; the end id, if asked for, has an empty
    span at the end. A null or empty text has the end id only and decodes to the empty string. Rows are kept one to one:
    repeated rows and null keys stay, other columns are left out. The space mark written out in a text is a space, and names of
    control pieces are ordinary text, as in the library.
    """
    spec = docs.sparkSession.sparkContext.broadcast(load(path))
    rows = docs.select(F.col(f"`{key}`"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(spec.value)
        for part in slices(batches):
            texts = part.column(1).to_pylist()
            packed, starts, stops = model.encode(texts)
            counts = np.fromiter((len(p) // 4 for p in packed), np.int64, len(packed))
            ids = np.frombuffer(b"".join(packed), np.int32)
            offsets = np.append(0, np.cumsum(counts))
            if end:
                sizes = np.fromiter((len(t.encode()) for t in texts), np.int64, len(texts))
                at = offsets[1:]
                ids, starts, stops = np.insert(ids, at, spec.value["end"]), np.insert(starts, at, sizes), np.insert(stops, at, sizes)
                offsets = offsets + np.arange(len(offsets))
            nested = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(x, pa.int32())) for x in (ids, starts, stops)]
            decoded = pa.array(model.decode(ids, offsets), pa.string())
            yield pa.RecordBatch.from_arrays([part.column(0), *nested, decoded], [key, "ids", "starts", "stops", "decoded"])

    kind = dict(rows.dtypes)[key]
    return rows.mapInArrow(run, f"`{key}` {kind}, ids array<int>, starts array<int>, stops array<int>, decoded string")


def digests(encoded: DataFrame, key: str = "doc_id") -> DataFrame:
    """Token count and digests of ids and decoded text; ``spans_mark`` is a hash of the spans."""
    return encoded.select(
        F.col(f"`{key}`"),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
        F.xxhash64("starts", "stops").alias("spans_mark"),
    )
