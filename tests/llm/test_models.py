"""SimHash, BPE, language, neighbours, URL rules, archives and mixing against plain versions."""

import base64
import hashlib
import heapq
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from glossa.llm import ann, bpe, langid, merges, mixing, simhash, urls, warc
from glossa.llm.queries import URL_RULES, vocabulary


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows, reach=4):
    marks = [plain_fingerprint(t) for _, t in rows]
    arr = np.array(marks, np.uint64)
    least = {}
    seen = [False] * len(rows)
    out = []
    for i in range(len(rows)):
        if seen[i]:
            continue
        group, stack = [], [i]
        seen[i] = True
        while stack:
            j = stack.pop()
            group.append(j)
            for n in np.flatnonzero(np.bitwise_count(arr ^ arr[j]) <= reach).tolist():
                if not seen[n]:
                    seen[n] = True
                    stack.append(n)
        ids = [rows[j][0] for j in group if rows[j][0] is not None]
        for j in group:
            least[j] = min(ids, default=None)
    for j, (ident, _) in enumerate(rows):
        out.append((ident, f"{marks[j]:016x}", least[j]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("shard", [8192, 24])
def test_simhash(docs, nasty, shard, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD_ROWS", shard)
    monkeypatch.setattr(simhash, "LEAF", 8)
    for df in (docs, nasty):
        rows = [(r.doc_id, r.text) for r in df.collect()]
        found = simhash.near_duplicates(df).select("doc_id", simhash.hex_mark("fp"), "component")
        assert sorted(map(tuple, found.collect()), key=repr) == plain_components(rows)


def test_links_of_dense_groups(spark, monkeypatch):
    """Chains and balls of fingerprints: the shards' forests connect what brute force connects."""
    monkeypatch.setattr(simhash, "SHARD_ROWS", 64)
    monkeypatch.setattr(simhash, "LEAF", 16)
    random = np.random.default_rng(3)
    seeds = random.integers(0, 1 << 63, 40, dtype=np.uint64)
    marks = set(seeds.tolist())
    for s in seeds[:6].tolist():
        at = s
        for _ in range(120):
            for _ in range(int(random.integers(1, 7))):
                at ^= 1 << int(random.integers(0, 64))
            marks.add(at)
    arr = np.array(sorted(marks), np.uint64)
    df = spark.createDataFrame([(int(x),) for x in arr.view(np.int64)], "fp long").repartition(4)
    found = {r.node: r.root for r in simhash.components(simhash.links(df)).collect()}
    group = {}
    for x in arr.view(np.int64).tolist():
        group.setdefault(found.get(x, x), set()).add(x)
    want, left = [], set(range(len(arr)))
    while left:
        stack, part = [left.pop()], set()
        while stack:
            j = stack.pop()
            part.add(int(arr.view(np.int64)[j]))
            near = {n for n in np.flatnonzero(np.bitwise_count(arr ^ arr[j]) <= 4).tolist() if n in left}
            left -= near
            stack += near
        want.append(frozenset(part))
    assert set(map(frozenset, group.values())) == set(want)
    assert all(root == min(part) for root, part in group.items())


def test_representatives(nasty):
    kept = simhash.representatives(nasty)
    assert kept.columns == nasty.columns
    rows = [(r.doc_id, r.text) for r in nasty.collect()]
    want = {c for _, _, c in plain_components(rows)}
    got = [r.doc_id for r in kept.collect()]
    assert set(got) == want and len(got) == len({plain for plain in map(tuple, plain_components(rows)) if plain[0] == plain[2]})


def test_bpe(docs, nasty):
    lib = Tokenizer.from_file(vocabulary())
    for df in (docs, nasty):
        got = Counter((r.doc_id, tuple(r.ids), r.decoded) for r in bpe.encode_decode(df, vocabulary()).collect())
        want = Counter()
        for r in df.collect():
            ids = lib.encode(r.text or "", add_special_tokens=False).ids
            want[(r.doc_id, tuple(ids), lib.decode(ids, skip_special_tokens=False))] += 1
        assert got == want


def test_bpe_digests(docs):
    lib = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    row = bpe.digests(bpe.encode_decode(docs.where("doc_id = 3"), vocabulary())).first()
    text = docs.where("doc_id = 3").first().text
    ids = lib.encode(text, add_special_tokens=False).ids
    assert row.n_tokens == len(ids) and row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert row.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def plain_merges(symbols, pairs):
    symbols = list(symbols)
    while True:
        found = [(pairs[p][0], i) for i, p in enumerate(zip(symbols, symbols[1:])) if p in pairs]
        if not found:
            return symbols
        rank, i = min(found)
        symbols[i : i + 2] = [pairs[symbols[i], symbols[i + 1]][1]]


def test_merges_take_leftmost_lowest():
    """Rows of every length beside one another, against merging one pair at a time."""
    random = np.random.default_rng(5)
    pairs = {(1, 1): (5, 2), (2, 2): (1, 3), (2, 1): (0, 4)}
    drawn = {(int(a), int(b)): (int(r), int(c)) for a, b, r, c in zip(*random.integers(0, 12, (2, 60)), random.permutation(60) + 6, random.integers(0, 12, 60))}
    for table in (pairs, drawn, {}):
        rows = [random.integers(0, 12, n).tolist() for n in [*range(1, 70), 1, 300, 1000]] + [[1, 1, 1], [1] * 4, [7], [1] * 33]
        flat, sizes = merges.Merges(table).merge(np.concatenate(rows), np.array(list(map(len, rows))))
        ends = np.cumsum(sizes)
        assert [flat[e - n : e].tolist() for e, n in zip(ends, sizes)] == [plain_merges(r, table) for r in rows]


def test_small_memo(docs, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO", 100)
    codec, lib = bpe.Codec(bpe.load(vocabulary())), Tokenizer.from_file(vocabulary())
    texts = [r.text or "" for r in docs.collect()]
    for start in range(0, len(texts), 20):
        part = texts[start : start + 20]
        got = [np.frombuffer(x, np.int32).tolist() for x in codec.encode(part)]
        assert got == [lib.encode(x, add_special_tokens=False).ids for x in part]


def test_pretokens_of_ascii():
    """The two spellings of the pattern cut alike: each pair of characters, among letters and blanks."""
    for a in map(chr, range(128)):
        for b in map(chr, range(128)):
            for text in (a + b, f"x{a}{b}1", f" {a}{b} "):
                assert bpe.ASCII(text) == bpe.ANY(text)


def test_invalid_ids_decode_with_replacement():
    codec = bpe.Codec(bpe.load(vocabulary()))
    lib = Tokenizer.from_file(vocabulary())
    ids = lib.encode("é汉", add_special_tokens=False).ids[1:]
    assert codec.decode(np.array(ids, np.int32), [0, len(ids)])[0].decode("utf-8", "replace") == lib.decode(ids, skip_special_tokens=False)


def test_language(docs, nasty, empty):
    field = langid.fit(docs)
    found = langid.identify(docs, field).withColumn("out", langid.held_out()).collect()
    for r in found:
        assert r.out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1
    held = [r for r in found if r.out and r.text and any(c.isalpha() for c in r.text)]
    assert sum(r.lang_pred == r.lang for r in held) >= 0.95 * len(held)
    odd = langid.identify(nasty, field).collect()
    assert len(odd) == nasty.count()
    for r in odd:
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or ""))
    nothing = langid.identify(nasty, langid.fit(empty)).collect()
    assert {r.lang_pred for r in nothing} == {"und"}


def test_letters_and_long_words(docs, spark, monkeypatch):
    """Numerals are no letters, marks belong to their word, and the middle of a long word counts."""
    assert langid.words_of("\u00bd \u00b2\u2167 12_3") == [] and langid.words_of("\u0939\u093f\u0928\u094d\u0926\u0940 \u00c9t\u00e9, e\u0301t\u00e92x") == ["\u0939\u093f\u0928\u094d\u0926\u0940", "\u00e9t\u00e9", "e\u0301t\u00e9", "x"]
    assert set(langid.features("a" * 60 + "xyz" + "a" * 60)) - set(langid.features("a" * 123))
    field = langid.fit(docs)
    told = field.predict(["\u00bd \u00b2", "\u2167", None, "", "12", "the" * 4000, "und " * 40 + "the " * 41])
    assert [x for x, _ in told[:5]] == [None] * 5 and told[5][0] == "en" and told[6][0] is not None
    texts = [r.text for r in docs.collect()]
    whole = field.predict(texts)
    monkeypatch.setattr(langid, "MEMO", 50)
    again = [x for i in range(0, len(texts), 9) for x in field.predict(texts[i : i + 9])]
    assert [a for a, _ in whole] == [a for a, _ in again] and np.allclose([a for _, a in whole], [a for _, a in again])
    assert all(len(w) <= langid.LONGEST for w in field.memo)
    clash = docs.limit(5).selectExpr("doc_id", "text", "1 as row", "2 as named", "3 as `_named`", "'x' as score")
    found = langid.identify(clash, field)
    assert found.columns == ["doc_id", "text", "row", "named", "_named", "lang_pred", "score"] and found.first()["_named"] == 3


def test_marginals_are_exact(monkeypatch):
    """Blocked forward-backward against the sum over all labellings."""
    import itertools

    monkeypatch.setattr(langid, "BLOCK", 3)
    random = np.random.default_rng(1)
    moves = random.normal(size=(3, 3))
    sizes = np.array([1, 3, 7, 4])
    scores = random.normal(size=(sizes.sum(), 3)) * 2
    got = langid.marginal_sums(scores, moves, sizes)
    at = 0
    for n, row in zip(sizes, got):
        total, sums = 0.0, np.zeros(3)
        for ys in itertools.product(range(3), repeat=int(n)):
            w = np.exp(sum(scores[at + i, y] for i, y in enumerate(ys)) + sum(moves[a, b] for a, b in itertools.pairwise(ys)))
            total += w
            for y in ys:
                sums[y] += w
        assert np.allclose(row, sums / total)
        at += n


def test_code_switching(docs):
    """A text of two languages shares its marginals by its words."""
    field = langid.fit(docs)
    one = {r.lang: r.text.split()[:200] for r in docs.where("n_chars > 3000").collect()}
    a, b = sorted(one)[:2]
    words = langid.words_of(" ".join(one[a] + one[b]))
    scores = np.array([field[w] for w in words])
    share = langid.marginal_sums(scores, field.moves, np.array([len(words)]))[0] / len(words)
    assert share[field.languages.index(a)] > 0.3 and share[field.languages.index(b)] > 0.3


def brute_neighbours(rows, k=5):
    good = [(i, np.array(v, float)) for i, v in rows if v is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v) and i is not None]
    out = {}
    for i, q in good:
        if i % 50 == 0:
            found = [(-float((v * q).sum() / (np.sqrt((v * v).sum()) * np.sqrt((q * q).sum()))), j) for j, v in good if j != i and len(v) == len(q)]
            out[i] = [(j, -s) for s, j in sorted(found)[:k]]
    return out


def test_neighbours(spark, sf, monkeypatch):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    want = brute_neighbours([(r.vec_id, r.embedding) for r in df.collect()])
    for shard in (16384, 100):
        monkeypatch.setattr(ann, "SHARD_ROWS", shard)
        monkeypatch.setattr(ann, "BLOCK_ROWS", 4 if shard == 100 else 8192)
        got = defaultdict(list)
        for r in ann.search(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
            got[r.query_id].append((r.vec_id, r.score))
        assert set(got) == set(want) and all(len(v) == 5 for v in got.values())
        hits = sum(len({j for j, _ in got[q]} & {j for j, _ in want[q]}) for q in want)
        assert hits >= 0.9 * 5 * len(want)


def test_neighbours_of_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [1.0, None])]
    rows += [(7, [float("nan"), 1.0]), (8, [float("inf"), 1.0]), (None, [1.0, 0.0]), (9, [-1.0, 0.1]), (50, [1.0, 2.0, 3.0]), (100, None), (1, [0.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit("x")).withColumn("v", F.lit(1))
    got = [(r.query_id, r.rank, r.vec_id) for r in ann.search(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 2), (0, 3, 1), (0, 4, 9)]
    assert ann.search(df.where("false"), F.lit(True)).count() == 0


def plain_url(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    ends = [rest.find(c) for c in "/?#" if c in rest]
    host = rest[: min(ends)] if ends else rest
    way = rest[len(host) :]
    cut = [way.find(c) for c in "?#" if c in way]
    way = way[: min(cut)] if cut else way
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = []
    for rule, _ in URL_RULES:
        name, _, tail = rule.partition("/")
        if (host == name or host.endswith("." + name)) and way.startswith("/" + tail):
            fits.append(rule)
    return host, way, max(fits, key=len, default=None)


def test_urls(spark, sf):
    df = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url")
    odd = [None, "", "nothing", "http://", "HTTP://A.Example.NET/en/x?y#z", "x://net/", "x://net", "x://internet/", "x://.net/a", "a://b.example.net/EN/"]
    odd += ["http://é.org/fr/", "x://org/fr/" + "a" * 50_000, "x://" + "a." * 2000 + "net/", "x://a.net\n/b://c", "q?u=http://a.example.com/de/?x", "x://example.com/de/", "x://org?/fr/"]
    odd = spark.createDataFrame([(-i, u) for i, u in enumerate(odd)], "page_id long, url string")
    df = df.union(odd).union(odd).withColumn("host", F.lit(1)).withColumn("rule", F.lit(2))
    got = Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.judge(df, URL_RULES).collect())
    verdict = dict(URL_RULES)
    want = Counter((r.page_id, *plain_url(r.url), verdict.get(plain_url(r.url)[2], "allow")) for r in df.collect())
    assert got == want
    assert urls.judge(df.where("false"), URL_RULES).count() == 0
    assert {r.verdict for r in urls.judge(odd, [], otherwise="block").collect()} == {"block"}


def test_url_rules_that_collide(spark, monkeypatch):
    monkeypatch.setattr(urls.xxhash, "xxh64_intdigest", lambda b, *a: len(b) % 2)
    index = urls.build(spark, [("a.b/", "block"), ("b/", "allow"), ("b/xyz", "block"), ("b/", "block")])
    from pyspark import SparkFiles

    found = urls.Rules(SparkFiles.get, index).judge(["x.a.b", "b", "c.b", "c"], ["/", "/xyzz", "", "/"])
    assert found == (["a.b/", "b/xyz", None, None], [True, True, False, False])


def test_archives(spark, sf):
    df = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html")
    odd = [(9001, "u\r\nX: y", "copy"), (9002, None, "copy"), (9003, "a", "copy"), (9003, "a", "copy"), (9001, "u", "copy"), (None, "b", "copy")]
    odd += [(9004, "c", None), (9005, "d", ""), (9006, "e", "é\r\n\r\nWARC/1.1\r\nContent-Length: 9\r\n\r\n"), (None, None, "alone"), (9007, "f", "x" * 2_000_000)]
    df = df.union(spark.createDataFrame(odd, df.schema)).withColumn("digest", F.lit(1)).withColumn("first", F.lit(1)).withColumn("key", F.lit("k"))
    for least in (0, 1, 5):
        got = Counter()
        for r in warc.round_trip(df, least=least).select(warc.told("key").cast("long").alias("k"), "response.*", warc.told("first").cast("long").alias("f"), F.size("requests").alias("n")).collect():
            got[(r.k, r.payload_bytes, r.payload_digest, r.type, r.f)] += 1
            assert r.n == 1
        rows = [(r.page_id, (r.html or "").encode()) for r in df.collect()]
        smallest = defaultdict(list)
        for ident, body in rows:
            smallest[body] += [ident] if ident is not None else []
        want = Counter()
        for ident, body in rows:
            first = min(smallest[body], default=None)
            again = first is not None and ident != first and len(body) >= least
            want[(ident, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if again else "response", first if again else None)] += 1
        assert got == want
    assert warc.round_trip(df.where("false")).count() == 0


def test_payload_and_unnamed_records(spark, tmp_path):
    one = "WARC/1.1\r\nWARC-Type: metadata\r\nWARC-Record-ID: <m>\r\nWARC-Concurrent-To: <gone>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    two = "WARC/1.0\r\nwarc-type: warcinfo\r\nWARC-Record-ID: <i>\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    (tmp_path / "a.warc").write_bytes((one + two).encode())
    got = {r.id: r for r in warc.assemble(warc.read(spark, str(tmp_path))).collect()}
    assert got["<gone>"].response is None and bytes(got["<gone>"].metadata[0].payload) == b"abc"
    assert got["<i>"].response is None and got["<i>"].requests == []


def edf(parts, blocks):
    """Slots of each source's blocks when every slot takes the released block that is due first."""
    slots = sum(parts.values())
    out, done = {}, dict.fromkeys(parts, 0)
    for t in range(max(-(-n * slots // parts[s]) for s, n in blocks.items()) + 1):
        ready = [(-(-(done[s] + 1) * slots // p), s) for s, p in parts.items() if done[s] * slots // p <= t]
        due, s = min(ready)
        out[s, done[s]] = t
        done[s] += 1
    return out


def test_mixing(docs, nasty):
    for df, weights in ((docs, None), (docs, {"src0": 5.0, "src1": 0.001}), (nasty, None)):
        rows = mixing.mix(df, weights, block=2).select("row.source", "row.doc_id", "block", "slot", "release", "deadline", "place").collect()
        assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in df.collect())
        blocks = defaultdict(set)
        for r in rows:
            blocks[r.source].add((r.block, r.slot))
            assert r.release <= r.slot < r.deadline and 0 <= r.place < 2
        assert len({s for found in blocks.values() for s in found}) == sum(map(len, blocks.values()))
        seats = Counter((r.source, r.block, r.place) for r in rows)
        assert set(seats.values()) == {1}
    counts = Counter(r.source for r in docs.collect())
    parts = mixing.whole_parts({f"={s}": n**0.5 for s, n in counts.items()})
    want = edf(parts, {f"={s}": -(-n // 2) for s, n in counts.items()})
    for r in mixing.mix(docs, block=2).select("row.source", "block", "slot").distinct().collect():
        assert want[f"={r.source}", r.block] == r.slot


def test_deviation_is_below_one_block():
    parts = mixing.whole_parts({"a": 0.61, "b": 0.3, "c": 0.07, "d": 0.02, "e": 1e-9})
    plan = mixing.period(parts)
    slots, had = sum(parts.values()), Counter()
    assert [p[2] for p in plan] == list(range(slots))
    for s, j, slot, release, deadline in plan:
        assert had[s] == j and release <= slot < deadline
        had[s] += 1
        assert all(abs(had[x] * slots - parts[x] * (slot + 1)) < slots for x in parts)
    assert had == parts
    with pytest.raises(ValueError):
        mixing.whole_parts({"a": 0.0})
    assert mixing.whole_parts({}) == {} and heapq


def test_mixing_nothing(empty):
    assert mixing.mix(empty).count() == 0
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.representatives(empty).count() == 0
    assert bpe.digests(bpe.encode_decode(empty, vocabulary())).count() == 0
