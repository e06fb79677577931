"""Conversation repair against trying all edits by a plain shortest-path search."""

import hashlib
import heapq
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from glossa.llm import repair

BLANKS = " \t\n\x0b\f\r"


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        said = lambda v: " " if v is None else str(v)
        fate = zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20
        role, text = said(role), said(text)
        if fate == 0:
            continue
        text = "" if fate == 1 else "".join(c for c in text if c not in ".!?") if fate == 2 else text
        out += [(conv, turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    return out


def plain_repair(rows):
    """Cheapest edits, ties by audit: uniform-cost search over (cost, audit)."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    seen, kinds = set(), []
    for _, _, role, text in rows:
        kind = "blank" if not text.strip(BLANKS) else "duplicate" if (role, text) in seen else "truncated" if text.rstrip(BLANKS)[-1] not in ".!?" else ""
        seen.add((role, text))
        kinds.append(kind)
    known = [r[1] for r in rows if r[1] is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    legal = lambda state, c: state == "" or (state, c) in (("s", "u"), ("u", "a"), ("a", "u"))
    heap, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, i, state, kept = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows) and state in ("", "a"):
            break
        for role in ("user", "assistant"):
            if legal(state, role[0]) and not (state == "" and role == "assistant"):
                heapq.heappush(heap, (cost + 3, audit + "I", i, role[0], (*kept, (role, ""))))
        if i < len(rows):
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, state, kept))
            if kinds[i] not in ("blank", "duplicate"):
                more = 3 if kinds[i] == "truncated" else 0
                _, _, role, text = rows[i]
                c = role[:1]
                if c in ("s", "u", "a") and (legal(state, c) if state else c in "su"):
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, c, (*kept, (role, text))))
                for role in ("user", "assistant"):
                    if legal(state, role[0]) and not (state == "" and role == "assistant"):
                        heapq.heappush(heap, (cost + 3 + more, audit + "R", i + 1, role[0], (*kept, (role, text))))
    text = "\n".join(f"{r}:{t}" for r, t in kept)
    return gaps, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()


def plain(rows):
    convs = defaultdict(list)
    for r in rows:
        convs[r[0]].append(r)
    return sorted(((c, *plain_repair(part)) for c, part in convs.items()), key=repr)


def drawn(seed, convs, most):
    random = np.random.default_rng(seed)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "u"]
    texts = ["one.", "two?", "three!", "cut", "", " \t", "é.\n", "汉", None, "a.b"]
    rows = []
    for c in range(convs):
        for _ in range(int(random.integers(1, most))):
            turn = None if random.random() < 0.1 else int(random.integers(0, most))
            good = random.random() < 0.6
            text = f"text {int(random.integers(0, 10**6))}." if good else texts[int(random.integers(0, len(texts)))]
            rows.append((c if c else None, turn, roles[int(random.integers(0, len(roles)))], text))
    return rows


@pytest.mark.parametrize("long, piece", [(512, 32), (4, 3)])
def test_against_all_edits(spark, long, piece, monkeypatch):
    monkeypatch.setattr(repair, "LONG", long)
    monkeypatch.setattr(repair, "PIECE", piece)
    monkeypatch.setattr(repair, "WHOLE", piece)
    repair.cheapest.cache_clear()
    rows = drawn(1, 60, 12) + drawn(2, 3, 60)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    extra = df.select("*", *[F.lit("x").alias(c) for c in ("conv", "mark", "of", "first", "_fate", "cost")])
    said = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    assert sorted(map(tuple, repair.repair(extra).collect()), key=repr) == plain(said)
    hurt = repair.for_all(repair.repair(repair.damaged(extra)), extra)
    left = plain(plain_damage(rows))
    gone = {r[0] for r in rows} - {r[0] for r in left}
    none = [(c, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest()) for c in gone]
    assert sorted(map(tuple, hurt.collect()), key=repr) == sorted([*left, *none], key=repr)


@pytest.mark.parametrize("long", [512, 3])
def test_tables(spark, sf, long, monkeypatch):
    monkeypatch.setattr(repair, "LONG", long)
    talks = spark.read.parquet(f"{sf}/conversations.parquet")
    found = sorted(map(tuple, repair.for_all(repair.repair(repair.damaged(talks)), talks).collect()), key=repr)
    left = plain(plain_damage([(r.conv_id, r.turn, r.role, r.text) for r in talks.collect()]))
    assert [r for r in found if r[-2]] == [r for r in left if r[-2]] and len(found) == talks.select("conv_id").distinct().count()


def test_empty(spark):
    none = spark.createDataFrame([], "conv_id string, turn int, role string, text string")
    assert repair.for_all(repair.repair(repair.damaged(none)), none).count() == 0
    one = spark.createDataFrame([("a.b", None, None, None)], none.schema)
    assert [tuple(r)[:8] for r in repair.repair(one).collect()] == [("a.b", 0, 1, 0, 0, 0, 4, "D")]


@pytest.mark.parametrize("long", [512, 64])
def test_long_conversation(spark, long, monkeypatch):
    """Thousands of rows, most of them wrong, and a third of them one row over and over."""
    monkeypatch.setattr(repair, "LONG", long)
    rows = [(1, i, "user", f"t{i}.") for i in range(1500)] + [(1, 7, "user", "same.")] * 900 + [(1, i, "system", "x") for i in range(400)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)
    assert list(map(tuple, repair.repair(df).collect())) == plain(rows)


def test_deepening_is_exact_and_bounded():
    """Every short run of codes, from and to each state, against the joined matrices of single rows."""
    import itertools

    for n in range(5):
        for codes in map("".join, itertools.product("suaxUA-", repeat=n)):
            single = {(q, q): (0, "") for q in range(4)}
            for c in codes:
                single = repair.joined(single, {(q, r): v for q in range(4) for r in range(4) if (v := repair.cheapest(c, q, r))})
            assert {(q, r): v for q in range(4) for r in range(4) if n and (v := repair.cheapest(codes, q, r))} == (single if n else {})
