"""WARC archives: writing captures, reading records, and assembling transactions.

A capture is a request, a response (or a revisit of an equal payload) and a metadata record; request and metadata name the
response in ``WARC-Concurrent-To``. Spark's text writer puts records into archive files, as its line separator is the end of a
record; files hold a bounded number of records and are one gzip member each (named ``.txt.gz`` by the writer). Reading goes record by
record by ``Content-Length``, so a payload may hold anything, and a task's memory is one compressed file and one record.
Assembly groups records by the response that they name: one nested row per capture.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir
from .common import stored

# Records of an archive file; three to a capture.
FILE_RECORDS = 1500
# The ends of a line and of a record, the digits of base 32 and of Spark's conv().
LINE, END = "\r\n", "\r\n\r\n"
BASE32, CONV32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789ABCDEFGHIJKLMNOPQRSTUV"
# Fixed value: the profile of a revisit whose payload is the same.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FIELDS = "type string, id string, concurrent_to string, refers_to string, uri string, payload_digest string, payload_bytes long, payload binary"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base-32 SHA-1: 40 bits, 10 hexadecimal and 8 base-32 digits, at a time."""
    digits = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digits, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), CONV32, BASE32)


def captures(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least: int = 0) -> DataFrame:
    """``capture`` id, ``key``, ``url``, ``html``, ``bytes``, ``digest`` and, for a revisit, ``first`` (key and capture of the response).

    Of captures with equal payloads of ``least`` bytes or more, that with the smallest key is the response, the others
    revisit it; captures with a smaller payload are responses. A null html is an empty payload. Rows that share the smallest
    key are all responses; a null key is never the smallest, unless there is no other.
    """
    page = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(F.uuid().alias("capture"), F.col(key).alias("key"), F.col(url).alias("url"), page.alias("html"))
    # Written once: the ids must be the same wherever they are read.
    rows = stored(rows.withColumn("bytes", F.octet_length("html").cast("long")).withColumn("digest", base32_sha1(F.col("html"))), "captures")
    some = F.when(F.col("key").isNotNull(), F.struct("key", "capture"))
    equal = rows.where(F.col("bytes") >= least).groupBy("digest").agg(F.min(some).alias("first"), F.count("*").alias("n"))
    # Stored before the join: with its size known, payloads are shuffled only if shared digests are too many to send.
    shared = stored(equal.where((F.col("n") > 1) & F.col("first").isNotNull()).select("digest", "first"), "shared")
    found = rows.join(shared, "digest", "left")
    other = F.col("first").isNotNull() & (F.col("bytes") >= least) & ~F.col("key").eqNullSafe(F.col("first.key"))
    return found.withColumn("first", F.when(other, F.col("first")))


def line(name: str, value: Column | str) -> Column:
    """A header line; null if the value is. Control characters are percent-encoded."""
    if isinstance(value, str):
        return F.lit(f"{name}: {value}{LINE}")
    safe = F.regexp_replace(F.regexp_replace(value, "\r", "%0D"), "\n", "%0A")
    return F.concat(F.lit(f"{name}: "), safe, F.lit(LINE))


def record(kind: Column | str, ident: Column, block: Column, *more: Column) -> Column:
    lines = [line("WARC-Type", kind), line("WARC-Record-ID", ident), line("WARC-Date", "2024-01-01T00:00:00Z"), *more]
    size = line("Content-Length", F.octet_length(block).cast("string"))
    return F.concat(F.lit(f"WARC/1.1{LINE}"), F.concat_ws("", *lines, size), F.lit(LINE), block)


def urn(capture: Column, kind: str) -> Column:
    return F.concat(F.lit("<urn:uuid:"), capture, F.lit(f":{kind}>"))


def write(rows: DataFrame, path: str) -> None:
    """Write the archives of ``captures``."""
    ident, revisit = urn(F.col("capture"), "response"), F.col("first").isNotNull()
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{LINE}Content-Type: text/html; charset=utf-8{LINE}Content-Length: "),
        F.col("bytes").cast("string"),
        F.lit(END),
        F.when(revisit, "").otherwise(F.col("html")),
    )
    uri, near = line("WARC-Target-URI", F.col("url")), line("WARC-Concurrent-To", ident)
    answer = record(
        F.when(revisit, "revisit").otherwise("response"),
        ident,
        http,
        uri,
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(revisit, line("WARC-Profile", PROFILE)),
        line("WARC-Refers-To", urn(F.col("first.capture"), "response")),
        line("Content-Type", "application/http; msgtype=response"),
    )
    asked = F.concat(F.lit("GET "), F.coalesce(F.regexp_replace("url", r"[\r\n\x20]", "+"), F.lit("/")), F.lit(f" HTTP/1.1{END}"))
    asking = record("request", urn(F.col("capture"), "request"), asked, uri, near, line("Content-Type", "application/http; msgtype=request"))
    told = F.concat_ws("", line("key", F.col("key").cast("string")), line("first", F.col("first.key").cast("string")))
    telling = record("metadata", urn(F.col("capture"), "metadata"), told, uri, near, line("Content-Type", "application/warc-fields"))
    lines = rows.select(F.explode(F.array(asking, answer, telling)).alias("value"))
    lines.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def parse(file: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of each record."""
    while True:
        first = file.readline()
        if not first:
            return
        if not first.startswith(b"WARC/"):
            if first.strip():
                raise ValueError("not a record")
            continue
        headers = {}
        while (row := file.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = row.decode().partition(":")
            headers[name.strip().lower()] = value.strip()
        block = file.read(int(headers["content-length"]))
        yield headers, block


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Records of the archives in a folder (gzip or plain), with ``FIELDS``.

    ``payload`` of a response is its HTTP body, of another record its block; digest and bytes are then its own. A revisit has no payload:
    its digest is the one that it states and its bytes the ``Content-Length`` of its HTTP headers. Without ``payload`` that column is null.
    """
    files = spark.read.format("binaryFile").load(path).select("content")
    names = [f.split()[0] for f in FIELDS.split(", ")]

    def rows(content: bytes) -> Iterator[tuple]:
        import base64
        import hashlib

        raw = io.BytesIO(content)
        for h, block in parse(gzip.GzipFile(fileobj=raw) if content[:2] == b"\x1f\x8b" else raw):
            kind, body = h["warc-type"], block
            digest = size = None
            if kind in ("response", "revisit"):
                head, _, body = block.partition(END.encode())
                if kind == "revisit":
                    digest = h.get("warc-payload-digest", "").removeprefix("sha1:") or None
                    told = dict(x.lower().split(b":", 1) for x in head.split(b"\r\n")[1:] if b":" in x).get(b"content-length")
                    size = int(told) if told else None
                    body = None
            if kind != "revisit":
                digest, size = base64.b32encode(hashlib.sha1(body).digest()).decode(), len(body)
            keep = body if payload or kind == "metadata" else None
            yield kind, h.get("warc-record-id"), h.get("warc-concurrent-to"), h.get("warc-refers-to"), h.get("warc-target-uri"), digest, size, keep

    kinds = [pa.string()] * 6 + [pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                out: list[tuple] = []
                held = 0
                for row in rows(content.as_py()):
                    out.append(row)
                    held += len(row[-1] or b"")
                    if len(out) >= 512 or held > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
                        out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    return files.mapInArrow(run, FIELDS)


def assemble(records: DataFrame) -> DataFrame:
    """One row per capture: its ``id``, ``response`` (of type response or revisit), ``requests`` and ``metadata``, nested.

    Records belong to the response that they name as concurrent; one that names none stands for itself. A capture whose
    response is missing has a null ``response``. Groups are single captures, so none grows with the input.
    """
    columns = F.struct("id", "type", "refers_to", "uri", "payload_digest", "payload_bytes", "payload")
    answer = F.col("type").isin("response", "revisit")
    of = lambda kind: F.array_sort(F.collect_list(F.when(F.col("type") == kind, columns)))
    capture = F.when(answer, F.col("id")).otherwise(F.coalesce("concurrent_to", "id"))
    return records.groupBy(capture.alias("id")).agg(F.max(F.when(answer, columns)).alias("response"), of("request").alias("requests"), of("metadata").alias("metadata"))


def round_trip(pages: DataFrame, key: str = "page_id", least: int = 0, payload: bool = False) -> DataFrame:
    """Write the pages' archives to the shared folder, read them and assemble the captures."""
    spark = pages.sparkSession
    path = shared_dir(spark, "warc")
    write(captures(pages, key, least=least), path)
    return assemble(read(spark, path, payload))


def told(name: str) -> Column:
    """A field of the capture's metadata record; null if it is not there."""
    value = F.regexp_extract(F.decode(F.col("metadata")[0]["payload"], "UTF-8"), rf"(?m)^{name}: ([^\r\n]*)\r?$", 1)
    return F.nullif(value, F.lit(""))
