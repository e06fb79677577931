"""Quality rules, personal data and secrets against plain Python."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import pytest

from glossa.llm import pii, quality, secrets

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words_of(text):
    return WORD.findall(text or "")


def base_counts(text):
    words = words_of(text)
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = set()
    for i, w in enumerate(windows):
        if often[w] > 1:
            covered |= {i, i + 1, i + 2}
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(words), sum(map(len, words)), symbols, dup, len(covered)


def line_key(line):
    return re.sub(r"[\x20\x09-\x0D]+", " ", re.sub("[0-9]+", "0", line.lower())).strip(" \t\n\x0b\f\r")


def judged(rows, limit, least_left):
    """(doc_id, text, host) rows with counts and verdicts."""
    holders = defaultdict(set)
    for place, (_, text, host) in enumerate(rows):
        for line in (text or "").split("\n"):
            if WORD.search(line):
                holders[host, line_key(line)].add(place)
    out = []
    for ident, text, host in rows:
        counts = base_counts(text)
        longest = {}
        for line in (text or "").split("\n"):
            if WORD.search(line):
                longest[line_key(line)] = max(longest.get(line_key(line), 0), len(line))
        total = sum(longest.values())
        gone = sum(n for k, n in longest.items() if len(holders[host, k]) > limit)
        left = 1 - gone / total if total else 1.0
        failed = counts[0] < 50 or 100 * counts[4] > 50 * counts[0]
        out.append((ident, *counts, failed, not failed and left >= least_left))
    return sorted(out, key=repr)


@pytest.mark.parametrize("limit", [0, 1, 3])
def test_quality(docs, nasty, limit):
    for df in (docs, nasty):
        rows = [(r.doc_id, r.text, r.source) for r in df.collect()]
        found = quality.quality(df, limit=limit).select(
            "row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
        )
        assert sorted(map(tuple, found.collect()), key=repr) == judged(rows, limit, quality.LEAST_LEFT)


def test_clean_text(spark):
    many = [(i, f"shared line 1\nown line {'x' * i}\n\nshared  LINE 2", "h") for i in range(4)]
    many += [(9, "shared line 1\nrest", "other"), (10, None, None)]
    df = spark.createDataFrame(many, "doc_id long, text string, source string")
    got = {r.row.doc_id: (r.clean_text, r.left_share) for r in quality.quality(df, limit=3).collect()}
    assert got[2][0] == "own line xx\n" and got[9][0] == "shared line 1\nrest" and got[10] == ("", 1.0)
    assert got[2][1] < 0.6


def test_copies_are_documents(spark):
    """Copies count as often as they are, but a line that a text repeats counts once."""
    rows = [(i, "w " * 60, "h") for i in range(30)] + [(99, "\n".join(["v " * 60, "v 1 " * 60, "v 22 " * 60] * 20), "h")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    told = lambda limit: {r.row.doc_id: r.left_share for r in quality.quality(df, limit=limit).collect()}
    assert set(told(30).values()) == {1.0}
    assert {k for k, v in told(29).items() if v == 0.0} == set(range(30)) and told(1)[99] == 1.0


def luhn(v):
    d = [int(c) for c in v if c.isdigit()]
    return 13 <= len(d) <= 19 and sum(sum(divmod(2 * x, 10)) if i % 2 else x for i, x in enumerate(reversed(d))) % 10 == 0


PII = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: luhn(m[0])),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= sum(c.isdigit() for c in m[0]) <= 15),
}
# Long runs that make Python's own search quadratic are cut here only; Spark sees them whole.
SLOW = re.compile(r"^(a+|(a\.)+@b\.c)$")


def base_of(text):
    out = []
    for kind, (pattern, good) in PII.items():
        out.append([f"{kind}:{m.start()}:{m.end()}" for m in re.finditer(pattern, text or "") if good(m)])
    return out


def test_base_spans(docs, nasty):
    for df in (docs, nasty):
        got = pii.digest(pii.sanitise(df)).collect()
        found = Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got)
        want = Counter()
        for r in df.collect():
            if r.text and SLOW.match(r.text):
                spans = [[f"email:0:{len(r.text)}"] if "@" in r.text else [], [], [], []]
            else:
                spans = base_of(r.text)
            digest = hashlib.sha256(",".join(x for s in spans for x in s).encode()).hexdigest()
            want[(r.doc_id, *map(len, spans), digest)] += 1
        assert found == want


def terms_of(rows):
    """Plain form of the disclosing terms: {text: {term: disclosure}}."""
    texts = {t or "" for _, t in rows}
    near, held = defaultdict(set), defaultdict(set)
    for text in texts:
        for spans in base_of(text):
            for span in spans:
                s, e = map(int, span.split(":")[1:])
                entity = text[s:e].lower()
                held[entity].add(text)
                for word in re.findall(r"[^\W_]+", text.lower()):
                    near[entity, word].add(text)
    words = {t: set(re.findall(r"[^\W_]+", t.lower())) for t in texts}
    out = defaultdict(dict)
    for (entity, word), both in near.items():
        if len(both) >= pii.SUPPORT and len(held[entity]) < len(texts):
            n, a, b = len(texts), len(held[entity]), sum(word in w for w in words.values())
            share = math.log2(len(both) * n / (a * b)) / math.log2(n / a)
            if share >= pii.GENERALISE - 1e-12:
                for text in held[entity]:
                    out[text][word] = max(out[text].get(word, -9), share)
    return out


def corpus():
    rows = [(i, f"plain words number{i} about the weather") for i in range(40)]
    rows += [(100 + i, f"Our Zorblat leader writes the letter{i} as boss@corp.example.com from Quux, the town") for i in range(6)]
    rows += [(200 + i, f"in Quux the weather was fine{i}") for i in range(2)]
    return rows + [(300, rows[40][1]), (301, None), (None, "")]


def test_disclosing_terms(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = terms_of(rows)
    assert any("zorblat" in t for t in want.values())
    got = {r.row.doc_id: r for r in pii.sanitise(df).collect()}
    for ident, text in rows:
        found = {x.v.lower() for x in got[ident].spans if x.kind == "term"}
        taken = [tuple(map(int, x.split(":")[1:])) for spans in base_of(text or "") for x in spans]
        outside = {m[0].lower() for m in re.finditer(r"[^\W_]+", text or "") if not any(m.start() < e and m.end() > s for s, e in taken)}
        assert found == set(want.get(text or "", {})) & outside
    clean = got[100].clean_text
    assert "boss@" not in clean and "<email>" in clean and "Zorblat" not in clean and "the" in clean
    assert got[0].clean_text == rows[0][1] and got[200].clean_text == rows[46][1]


def test_clean_text_of_overlapping_spans(spark):
    df = spark.createDataFrame([(1, "call +4111 1111 1111 1111 now")], "doc_id long, text string")
    row = pii.sanitise(df).first()
    assert {x.kind for x in row.spans} == {"card"} and row.clean_text == "call +<card> now"


SECRETS = [
    ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I, lambda m: len(m[2]) >= 12),
    ("access", r"AKIA[A-Z0-9]+", 0, lambda m: len(m[0]) >= 18),
    ("hex", r"[0-9a-f]+", 0, lambda m: len(m[0]) >= 16),
    *((r.kind, r.pattern, 0, lambda m: True) for r in secrets.MORE),
]


def test_secrets(docs, nasty):
    for df in (docs, nasty):
        got = Counter(map(tuple, secrets.digest(secrets.scan(df)).collect()))
        want = Counter()
        for r in df.collect():
            spans = []
            for k, (kind, pattern, flags, good) in enumerate(SECRETS):
                spans += [(m.start(), k, m.end(), kind) for m in re.finditer(pattern, r.text or "", flags | re.A) if good(m)]
            spans.sort()
            show = lambda some: ",".join(f"{x[3]}:{x[0]}:{x[2]}" for x in some)
            base = [x for x in spans if x[1] < 3]
            counts = [sum(x[1] == k for x in base) for k in range(3)]
            want[(r.doc_id, *counts, hashlib.sha256(show(base).encode()).hexdigest(), show(spans))] += 1
        assert got == want


def test_trigram_queries():
    assert secrets.trigram_query("AKIA[A-Z0-9]+") == [frozenset({"aki", "kia"})]
    assert secrets.trigram_query("[0-9a-f]{16,}") is None
    assert secrets.trigram_query("(ab|cde)f?[gh]*") is None
    assert set(secrets.trigram_query("api_?key")) == {frozenset({"api", "pi_", "i_k", "_ke", "key"}), frozenset({"api", "pik", "ike", "key"})}
    assert secrets.trigram_query("(abc){2}x") == [frozenset({"abc"})]


def test_empty(empty):
    assert quality.quality(empty).count() == 0
    assert secrets.scan(empty).count() == 0
    assert pii.sanitise(empty).count() == 0
    assert pii.digest(pii.sanitise(empty)).columns[-1] == "spans"


def test_native_plans(docs):
    for df in (quality.quality(docs), secrets.digest(secrets.scan(docs)), pii.digest(pii.sanitise(docs))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
