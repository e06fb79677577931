"""Pieces, their places and decoding against the library."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from glossa.llm import pieces

PATH = str(public_tokenizers.path("piece_bpe_32k.model"))
ODD = ["", " ", "  ", "\u2581", "a\u2581 b", "\x00", "</s> <s> <unk> <0x41>", "\ufffd\ufeff", "h\u00e9llo  \u2603\ufe0f\n x", "\uff21\uff22\u3000\u00a0 \ufb01 \u2460", "e\u0301 \u1e9b\u0323 \uac00\u1100\u1161",
       "\t tab\r\n", " x ", "\U0001f600\U0001f468\u200d\U0001f469", "\u0644\u0627 \u0e33 \u0939\u093f\u0928\u094d\u0926\u0940", "x" * 3000, " " * 3000, "ab" * 2000 + "\u6c49" * 50]


def varint(n):
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def with_normalizer(rule, **switches):
    """The model with another compiled character map, which the library carries itself."""
    with open(PATH, "rb") as file:
        data = file.read()
    own = sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto()
    spec = b"".join(v for n, v in pieces.fields(own) if n == 3)
    for field, value in switches.items():
        spec += varint({"prefix": 3, "trim": 4}[field] << 3) + varint(value)
    return data + b"\x1a" + varint(len(spec)) + spec


def check(data, texts):
    lib = sentencepiece.SentencePieceProcessor(model_proto=data)
    model = pieces.Pieces(pieces.parse(data) | {"key": ""})
    packed, starts, stops = model.encode(texts)
    ids = [np.frombuffer(p, np.int32).tolist() for p in packed]
    assert ids == [lib.encode(t) for t in texts]
    flat, ends = [i for row in ids for i in row], np.cumsum([0, *map(len, ids)])
    assert model.decode(np.array(flat, np.int32), ends) == [lib.decode(row) for row in ids]
    for t, a, b in zip(texts, ends, ends[1:]):
        told = [(p.begin, p.end) for p in lib.encode(t, return_type="proto").pieces]
        assert list(zip(starts[a:b].tolist(), stops[a:b].tolist())) == told, t


def test_library_on_odd_texts(docs):
    with open(PATH, "rb") as file:
        check(file.read(), ODD + [r.text or "" for r in docs.limit(60).collect()])


@pytest.mark.parametrize("switches", [{"prefix": 1, "trim": 0}, {"prefix": 1, "trim": 1}, {"prefix": 0, "trim": 1}, {"prefix": 0, "trim": 0}])
def test_character_maps(docs, switches):
    """Longest prefixes of the map, with the places of what they rewrite."""
    texts = [*ODD, "  \uff21  b\u3000 ", "\u3000\u3000"] + [r.text[:300] for r in docs.where("text is not null").limit(20).collect()]
    for rule in ("nmt_nfkc", "nfkc_cf"):
        check(with_normalizer(rule, **switches), texts)


def test_every_character():
    with open(PATH, "rb") as file:
        data = file.read()
    points = [c for c in range(0x11000) if not 0xD800 <= c < 0xE000] + list(range(0x1F300, 0x1F700))
    check(data, ["".join(f"{chr(c)} a{chr(c)}" for c in points[i : i + 500]) for i in range(0, len(points), 500)])


def test_ids_that_are_no_text():
    with open(PATH, "rb") as file:
        data = file.read()
    lib, model = sentencepiece.SentencePieceProcessor(model_proto=data), pieces.Pieces(pieces.parse(data) | {"key": ""})
    random = np.random.default_rng(2)
    rows = [random.integers(3, 259, 12).tolist() for _ in range(300)] + [random.integers(0, 32000, 9).tolist() for _ in range(300)] + [[1, 1, 259, 5], [29871, 29871], []]
    ends = np.cumsum([0, *map(len, rows)])
    assert model.decode(np.array([i for r in rows for i in r], np.int32), ends) == [lib.decode(r) for r in rows]


def test_query_rows(nasty, empty, monkeypatch):
    monkeypatch.setattr(pieces, "MEMO", 50)
    lib = sentencepiece.SentencePieceProcessor(model_file=PATH)
    got = pieces.digests(pieces.encode_decode(nasty, PATH)).collect()
    hashed = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for r in nasty.collect():
        ids = lib.encode(r.text or "", add_eos=True)
        want.append((r.doc_id, len(ids), hashed(" ".join(map(str, ids))), hashed(lib.decode(ids))))
    assert sorted((tuple(r)[:4] for r in got), key=repr) == sorted(want, key=repr)
    assert pieces.encode_decode(empty, PATH).count() == 0
    whole = pieces.encode_decode(nasty, PATH).where("doc_id = 6").first()
    assert whole.stops[-1] == whole.starts[-1] == len("one two three") and whole.starts[0] == 0
    assert [(a, b) for a, b in zip(whole.stops, whole.starts[1:])] == [(a, a) for a in whole.stops[:-1]]
