"""WARC archives: writing captures, reading archives back and assembling each capture from its records.

``write`` turns pages into request, response or revisit, and metadata records and writes them as gzip-compressed WARC
1.1 files through Spark's own text sink, whose line separator is the record separator; so any file system that Spark
knows will do and lost tasks are simply written again. ``read`` parses whole files by Content-Length.
``assemble`` joins a capture's records through WARC-Concurrent-To and emits one nested row a capture.

Defined results: every row is a capture of its own, repeated rows and page_ids included. A null html is an empty payload
and a null url an empty one; a row with a null page_id has no page-id line in its metadata and reads back as null. Of
equal payloads (same SHA-256 and length) one row with the largest page_id (of equal ones, the largest url) is stored, the
others are revisits of it; null ids are the smallest.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, scratch, ship

DATE = "2024-01-01T00:00:00Z"
#: A file, which a reader parses whole, has at most so many pages, and fewer if the largest payloads would make it larger
#: than so many bytes.
PAGES_PER_FILE, FILE_BYTES = 500, 1 << 30
_B32 = ("0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
RECORD = "record_id string, record_type string, concurrent_to string, refers_to string, target_uri string, date string, payload_digest string, payload_bytes long, page_id long, original_page_id long, payload binary"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1, with built-in functions: 5 bytes at a time are 8 digits to base 32."""
    h = F.sha1(payload)
    return F.concat(*(F.translate(F.lpad(F.conv(F.substring(h, i, 10), 16, 32), 8, "0"), *_B32) for i in (1, 11, 21, 31)))


def _uuid(name: Column, kind: str) -> Column:
    h = F.md5(F.concat(F.lit(f"{kind}:"), name))
    return F.concat(F.lit("urn:uuid:"), *(x for i, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for x in ((F.lit("-"),) if i > 1 else ()) + (F.substring(h, i, n),)))


def _record(kind: Column | str, rid: Column, uri: Column, headers: Column, block: Column, mime: str) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), kind, F.lit("\r\nWARC-Record-ID: <"), rid, F.lit(">\r\nWARC-Target-URI: "), uri,
        F.lit(f"\r\nWARC-Date: {DATE}\r\n"), headers, F.lit(f"Content-Type: {mime}\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"), block,
    )


def digests(pages: DataFrame) -> DataFrame:
    """(same, n, owner, owner_uri, times, rows) of pages (id, uri, same, n): how many rows each payload has, the largest
    (id, uri) among them, and how many rows have that. Rows of one payload are summed before they are shuffled."""
    each = pages.groupBy("same", "n", "id", "uri").agg(F.count("*").alias("times"))
    best = each.groupBy("same", "n").agg(F.max(F.struct("id", "uri", "times")).alias("o"), F.sum("times").alias("rows"))
    return best.select("same", "n", F.col("o.id").alias("owner"), F.col("o.uri").alias("owner_uri"), F.col("o.times").alias("times"), "rows")


def write(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0) -> None:
    """Writes the captures of pages to path. Payloads under min_bytes bytes are never revisits.

    Digests are counted first, without the payloads; payloads then move once, to meet what is known of their digest if it
    repeats. That join's larger side can be split where a digest is frequent."""
    p = pages.select(F.col(page_id).cast("long").alias("id"), F.regexp_replace(F.coalesce(F.col(url).cast("string"), F.lit("")), r"[\x00-\x20\x7F]", "%20").alias("uri"), F.coalesce(html, F.lit("")).alias("body"))
    p = p.withColumns({"n": F.octet_length("body"), "same": F.unhex(F.sha2(F.col("body").cast("binary"), 256))})
    known = materialise(digests(p.select("id", "uri", "same", "n")), "digests")
    repeats = known.where((F.col("rows") > 1) & (F.col("n") >= min_bytes))
    most = known.agg(F.max("n").alias("n"), F.max(F.when((F.col("rows") > 1) & (F.col("n") >= min_bytes), F.col("times"))).alias("times")).first()
    p = p.join(repeats.hint("merge"), ["same", "n"], "left")
    own = F.col("rows").isNotNull() & F.col("id").eqNullSafe(F.col("owner")) & F.col("uri").eqNullSafe(F.col("owner_uri"))
    # Of several rows alike that could be stored, one is.
    several = own & (F.col("times") > 1)
    if (most["times"] or 0) > 1:
        kept = p.where(several).groupBy("same", "n").agg(*(F.first(c).alias(c) for c in ("id", "uri", "body", "owner", "owner_uri", "times", "rows")))
        kept = kept.withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
        p = p.where(~several).withColumn("nth", F.lit(1)).unionByName(kept)
    else:
        p = p.withColumn("nth", F.lit(1))
    stored = own & (F.col("nth") == 1)
    old = F.col("rows").isNotNull() & ~stored
    # Records that others refer to are named by their payload, all others by their row.
    p = p.withColumns({"old": old, "original": F.concat(F.hex("same"), F.lit("-"), F.col("n").cast("string"))})
    p = p.withColumn("name", F.when(stored, F.col("original")).otherwise(F.concat_ws("-", F.col("original"), F.col("id").cast("string"), F.monotonically_increasing_id().cast("string"))))
    old = F.col("old")
    sha = F.concat(F.lit("sha1:"), base32_sha1(F.col("body").cast("binary")))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit("\r\n\r\n"))
    main, ask, meta = (_uuid(F.col("name"), k) for k in ("response", "request", "metadata"))
    to_main = F.concat(F.lit("WARC-Concurrent-To: <"), main, F.lit(">\r\n"))
    digest = F.concat(F.lit("WARC-Payload-Digest: "), sha, F.lit("\r\n"))
    seen = F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: <"), _uuid(F.col("original"), "response"), F.lit(">\r\nWARC-Refers-To-Target-URI: "), F.col("owner_uri"), F.lit("\r\n"))
    line = lambda name, c: F.coalesce(F.concat(F.lit(f"{name}: "), c.cast("string"), F.lit("\r\n")), F.lit(""))
    records = F.array(
        _record("request", ask, F.col("uri"), to_main, F.concat(F.lit("GET "), F.col("uri"), F.lit(" HTTP/1.1\r\n\r\n")), "application/http; msgtype=request"),
        _record(F.when(old, "revisit").otherwise("response"), main, F.col("uri"), F.concat(digest, F.when(old, seen).otherwise("")), F.when(old, http).otherwise(F.concat(http, "body")), "application/http; msgtype=response"),
        _record("metadata", meta, F.col("uri"), to_main, F.concat(line("page-id", F.col("id")), F.when(old, line("original-page-id", F.col("owner"))).otherwise("")), "application/warc-fields"),
    )
    per_file = max(1, min(PAGES_PER_FILE, FILE_BYTES // max(1, most["n"] or 0)))
    # A capture is one row of the sink, so that it is whole in one file.
    p.select(F.array_join(records, "\r\n\r\n").alias("value")).write.options(lineSep="\r\n\r\n", compression="gzip", maxRecordsPerFile=per_file).text(path)


def parse(data: bytes, with_payload: bool = True):
    """A tuple in the order of RECORD for each record of one WARC file, gzip-compressed or not."""
    f = io.BytesIO(data)
    f = io.BufferedReader(gzip.GzipFile(fileobj=f)) if data[:2] == b"\x1f\x8b" else f
    strip = lambda x: x.strip("<> ") if x else None
    while line := f.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        head: dict[str, str] = {}
        while (line := f.readline()).strip():
            k, _, v = line.decode("utf-8", "replace").partition(":")
            head[k.strip().lower()] = v.strip()
        size = int(head.get("content-length", 0))
        block = f.read(size)
        if len(block) < size:
            raise ValueError("a WARC record is cut off")
        kind, payload, n, page, original = head.get("warc-type"), block, size, None, None
        if kind in ("response", "revisit", "request") and head.get("content-type", "").startswith("application/http"):
            http, _, payload = block.partition(b"\r\n\r\n")
            n = len(payload)
            if kind == "revisit":
                n = next((int(x[15:]) for x in http.lower().split(b"\r\n") if x.startswith(b"content-length:")), n)
        digest = head.get("warc-payload-digest", "").removeprefix("sha1:") or None
        if kind == "response":
            own = base64.b32encode(hashlib.sha1(payload).digest()).decode()
            if digest not in (None, own):
                raise ValueError(f"payload digest of {head.get('warc-record-id')} doesn't match")
            digest = own
        if kind == "metadata":
            page, original = (next((int(x[len(k) :]) for x in block.split(b"\r\n") if x.startswith(k)), None) for k in (b"page-id:", b"original-page-id:"))
        yield strip(head.get("warc-record-id")), kind, strip(head.get("warc-concurrent-to")), strip(head.get("warc-refers-to")), head.get("warc-target-uri"), head.get("warc-date"), digest, n, page, original, payload if with_payload else None


def read(spark, path: str, with_payload: bool = True) -> DataFrame:
    """The records of all archives at path, a row each."""
    ship(spark)
    schema = spark.createDataFrame([], RECORD).schema

    def run(batches):
        kinds = [pa.string()] * 7 + [pa.int64()] * 3 + [pa.binary()]
        for b in batches:
            for x in b.column(0):
                rows, held = [], 0
                for r in parse(x.as_py(), with_payload):
                    rows.append(r)
                    held += len(r[-1] or b"")
                    if len(rows) >= 4096 or held > 1 << 24:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=schema.names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=schema.names)

    # Files are whole rows here: few at a time cross to Python.
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)


def assemble(records: DataFrame) -> DataFrame:
    """One row a capture: capture_id, and the structs ``request``, ``response`` (a response or revisit) and ``metadata``.
    A record joins the capture of the record that its concurrent-to names, or begins its own. Missing records are null;
    of several of a kind in a capture, the one with the smallest id is taken. Records without an id are left out."""
    key = F.coalesce("concurrent_to", "record_id")
    row = F.struct(*(c for c in records.columns))
    pick = lambda *kinds: F.min_by("r", F.when(F.col("r.record_type").isin(*kinds), F.col("r.record_id")))
    grouped = records.where(F.col("record_id").isNotNull()).select(key.alias("capture_id"), row.alias("r")).groupBy("capture_id")
    return grouped.agg(pick("request").alias("request"), pick("response", "revisit").alias("response"), pick("metadata").alias("metadata"))


def round_trip(pages: DataFrame, min_bytes: int = 0, path: str | None = None) -> DataFrame:
    """Writes pages to archives, reads them back and tells of every page how it was stored."""
    spark = pages.sparkSession
    path = path or scratch(spark, "warc")
    write(pages, path, min_bytes=min_bytes)
    got = assemble(read(spark, path, with_payload=False))
    # A revisit's own metadata names the page behind the record that it refers to, so nothing is looked up.
    return got.select(
        F.col("metadata.page_id").alias("page_id"), F.col("response.payload_bytes").alias("payload_bytes"), F.col("response.payload_digest").alias("payload_digest"), F.col("response.record_type").alias("record_type"),
        F.when(F.col("response.record_type") == "revisit", F.col("metadata.original_page_id")).alias("refers_to"),
    )
