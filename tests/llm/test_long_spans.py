"""Texts of a few megabytes with a match every few characters: every span is found and replaced, in time that grows with the text."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from glossa.llm import pii, secrets, spans


def shown(kind, pattern, text):
    return [f"{kind}:{m.start()}:{m.end()}" for m in re.finditer(pattern, text)]


@pytest.fixture(scope="module")
def texts():
    return ["1.2.3.4 " * 250_000, "deadbeefdeadbeef\U0001f600 " * 110_000, "joe@mail.example.com\n" * 100_000]


def test_personal_data(spark, texts):
    rows = pii.sanitise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    got = {r.doc_id: r for r in pii.digest(rows).collect()}
    clean = {r.row.doc_id: r.clean_text for r in rows.collect()}
    ips, mails = shown("ip", r"[0-9]+(?:\.[0-9]+){3}", texts[0]), shown("email", r"[a-z]+@[a-z.]+", texts[2])
    assert [got[0].n_ip, got[1].n_ip, got[2].n_email] == [250_000, 0, 100_000]
    for i, want in ((0, ips), (1, []), (2, mails)):
        assert got[i].spans == ",".join(want)
        assert got[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
    assert clean == {0: "<ip> " * 250_000, 1: texts[1], 2: "<email>\n" * 100_000}


def test_secrets(spark, texts):
    rows = secrets.digest(secrets.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    got = {r.doc_id: r for r in rows.collect()}
    assert [got[i].n_hex for i in range(3)] == [0, 110_000, 0]
    assert got[1].spans == ",".join(shown("hex", "[0-9a-f]{16,}", texts[1]))


def test_terms(spark):
    unit = "Zorblat wrote xj42 \U0001f600 to 10.2.3.4xj42 and "
    rows = [(i, f"plain words number{i} about the weather and what he wrote to") for i in range(40)]
    rows += [(100 + i, f"letter{i} " + unit * 2_000) for i in range(4)]
    got = {r.row.doc_id: r for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i in range(4):
        row = got[100 + i]
        assert {x.v for x in row.spans if x.kind == "term"} == {"Zorblat", "xj42"}
        # The word that the address runs into is the address's.
        assert len(row.spans) == 3 * 2_000
        assert row.clean_text == f"letter{i} " + " wrote  \U0001f600 to <ip>xj42 and " * 2_000
    assert got[0].clean_text == rows[0][1]


KIND = "struct<s:int,k:int,e:int>"


def test_apart_against_all_pairs(spark):
    sets = [[(s * 7 % 50, k, s * 7 % 50 + 1 + (s * step) % 5) for s, k in zip(range(n), (1, 0, 1, 1, 0) * n)] for n in range(40) for step in (1, 3)]
    sets = [sorted({(s, k, e) for s, k, e in rows if k == 0 or s % 3 == 0}) for rows in sets]
    df = spark.createDataFrame([(i, rows) for i, rows in enumerate(sets)], f"i int, x array<{KIND}>")
    got = {r.i: sorted(map(tuple, r.y)) for r in df.select("i", spans.apart(F.sort_array("x"), 1).alias("y")).collect()}
    for i, rows in enumerate(sets):
        assert got[i] == [a for a in rows if a[1] == 1 and not any(b[1] == 0 and a[0] < b[2] and a[2] > b[0] for b in rows)]
