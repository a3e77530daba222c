"""WARC archives: written from captures, read back, and assembled.

Each capture gives three records with ids of their own: the response (or a revisit, if a capture
with a smaller id has the same payload), the request and metadata, the last two concurrent to the first. Reading joins
them through WARC-Concurrent-To into one nested row per capture; a revisit finds the capture it
refers to by its payload digest.

Archives are written by Spark's text writer with the record end CR LF CR LF as line separator, so
they go to any store Spark writes to and appear only when a task commits. Segments of
`SEGMENT` bytes and `FILE_SEGMENTS` of them per file bound what one task reads back.

Defined results: a null payload is empty; a null url gives an empty target; a null id gives a
capture without id (a revisit of the smallest id with its payload, or a response if all are null); rows that repeat
the smallest id and its payload are all responses; empty tables give no records; other columns
aren't read. Control characters in urls are percent-encoded in headers.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from .common import blocks, small_side

SEGMENT = 4 << 20
FILE_SEGMENTS = 4
CRLF = "\r\n"
END = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"  # RFC 4648 (fixed value), for the SQL below


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _record(kind: str, rid: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{rid}>", f"WARC-Date: {DATE}",
             *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}"]
    return (CRLF.join(lines) + END).encode() + block


def _clean(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")


def _write_records(batches):
    for batch in batches:
        for rb in blocks(batch, "payload", SEGMENT // 2):
            parts, size, out = [], 0, []
            for r in rb.to_pylist():
                body = (r["payload"] or "").encode()
                uri, page = _clean(r["url"]), r["page_id"]
                ids = [str(uuid.uuid4()) for _ in range(3)]
                target = [("WARC-Target-URI", uri)]
                near = [*target, ("WARC-Concurrent-To", f"<urn:uuid:{ids[0]}>")]
                head = (f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}"
                        f"Content-Length: {len(body)}{END}").encode()
                http = [*target, ("WARC-Payload-Digest", "sha1:" + base32(bytes.fromhex(r["digest"]))),
                        ("Content-Type", "application/http; msgtype=response")]
                if r["revisit"]:
                    first = _record("revisit", ids[0], [*http, ("WARC-Profile", PROFILE)], head)
                else:
                    first = _record("response", ids[0], http, head + body)
                m = re.match(r"[^:]*://([^/?#]*)([^#]*)", uri)
                host, path = m.groups() if m else ("", "")
                ask = f"GET {path or '/'} HTTP/1.1{CRLF}Host: {host}{END}".encode()
                note = "" if page is None else f"page_id: {page}{CRLF}"
                trio = [first, _record("request", ids[1], [*near, ("Content-Type", "application/http; msgtype=request")], ask),
                        _record("metadata", ids[2], [*near, ("Content-Type", "application/warc-fields")], note.encode())]
                parts += trio
                size += sum(map(len, trio))
                if size >= SEGMENT:
                    out.append(END.encode().join(parts))
                    parts, size = [], 0
            if parts:
                out.append(END.encode().join(parts))
            yield pa.RecordBatch.from_arrays([pa.array([x.decode() for x in out], pa.string())], names=["value"])


def write_archive(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", payload: str = "html",
                  least_bytes: int = 0) -> None:
    """Write every row's three records below `path`. Payloads of fewer than `least_bytes` are never revisits."""
    text = F.coalesce(F.col(payload).cast("string"), F.lit(""))
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), text.alias("payload"))
    light = rows.select("page_id", F.sha1("payload").alias("digest"), F.octet_length("payload").alias("bytes")).filter(
        F.col("bytes") >= least_bytes)
    again = light.groupBy("digest", "bytes").agg(F.min("page_id").alias("first"), F.count("*").alias("n")) \
        .filter("n > 1").select("digest", "bytes", "first", F.lit(True).alias("again"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("bytes", F.octet_length("payload"))
    dealt = rows.join(small_side(again), ["digest", "bytes"], "left").select(
        "page_id", "url", "payload", "digest",
        (F.coalesce("again", F.lit(False)) & ~F.col("page_id").eqNullSafe(F.col("first"))).alias("revisit"))
    dealt.mapInArrow(_write_records, "value string").write.option("lineSep", END).option("compression", "gzip") \
        .option("maxRecordsPerFile", FILE_SEGMENTS).text(path)


RECORD = ("record_id string, type string, date string, target_uri string, concurrent_to string, profile string, "
          "payload_bytes bigint, payload_digest string, stated_digest string, fields map<string,string>, payload string")
_ARROW = pa.schema([("record_id", pa.string()), ("type", pa.string()), ("date", pa.string()), ("target_uri", pa.string()),
                    ("concurrent_to", pa.string()), ("profile", pa.string()), ("payload_bytes", pa.int64()),
                    ("payload_digest", pa.string()), ("stated_digest", pa.string()),
                    ("fields", pa.map_(pa.string(), pa.string())), ("payload", pa.string())])


def parse_records(data: bytes, with_payload: bool):
    """The records of an archive, one after the other (dicts of RECORD)."""
    at, n = 0, len(data)
    while at < n:
        stop = data.find(b"\r\n\r\n", at)
        if stop < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        h = {}
        for line in data[at:stop].split(b"\r\n")[1:]:
            k, _, v = line.partition(b":")
            h[k.strip().lower().decode()] = v.strip().decode()
        size = int(h["content-length"])
        block = data[stop + 4:stop + 4 + size]
        if len(block) != size:
            raise ValueError("a record is cut short")
        at = stop + 4 + size + 4
        kind = h.get("warc-type")
        row = {"record_id": h.get("warc-record-id"), "type": kind, "date": h.get("warc-date"),
               "target_uri": h.get("warc-target-uri"), "concurrent_to": h.get("warc-concurrent-to"),
               "profile": h.get("warc-profile"), "stated_digest": h.get("warc-payload-digest", "").removeprefix("sha1:") or None}
        if kind == "response":
            body = block[block.find(b"\r\n\r\n") + 4:]
            row |= {"payload_bytes": len(body), "payload_digest": base32(hashlib.sha1(body).digest()),
                    "payload": body.decode("utf-8", "replace") if with_payload else None}
        elif kind == "revisit":  # its headers tell of the payload elsewhere
            m = re.search(rb"(?im)^content-length:\s*([0-9]+)", block)
            row |= {"payload_bytes": int(m[1]) if m else None, "payload_digest": row["stated_digest"]}
        elif kind == "metadata":
            row["fields"] = [(k.strip(), v.strip()) for k, _, v in
                             (x.partition(":") for x in block.decode("utf-8", "replace").splitlines()) if k.strip()]
        yield row


def _read(with_payload: bool):
    def run(batches):
        for b in batches:
            for raw in b.column("content"):
                data = raw.as_py()
                if data[:2] == b"\x1f\x8b":
                    out = []
                    while data:
                        z = zlib.decompressobj(31)
                        out.append(z.decompress(data) + z.flush())
                        data = z.unused_data
                    data = b"".join(out)
                rows = list(parse_records(data, with_payload))
                yield pa.RecordBatch.from_pylist(rows, _ARROW)
    return run


def read_records(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row per record of all archives below `path` (gzip or plain). A response's digest is taken from
    the payload read; a revisit's from its headers."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(_read(with_payload), RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: its response (or revisit), request and metadata, and the page_id that the
    payload was first met with. Concurrent records that name no capture here are left out."""
    first = records.filter("type IN ('response', 'revisit')")
    near = records.filter("type IN ('request', 'metadata') AND concurrent_to IS NOT NULL").groupBy(
        F.col("concurrent_to").alias("record_id")).agg(
        F.max(F.when(F.col("type") == "request", F.struct("record_id", "target_uri", "date"))).alias("request"),
        F.max_by(F.struct("record_id", "fields"), F.when(F.col("type") == "metadata", F.col("record_id"))).alias("metadata"))
    captures = first.join(near, "record_id", "left").select(
        F.col("metadata.fields")["page_id"].cast("bigint").alias("page_id"),
        F.struct("record_id", "type", "date", "target_uri", "profile", "payload_bytes", "payload_digest", "stated_digest",
                 "payload").alias("response"), "request", "metadata")
    known = captures.filter("response.type = 'response'").groupBy(
        F.col("response.payload_digest").alias("digest"), F.col("response.payload_bytes").alias("bytes")) \
        .agg(F.min("page_id").alias("first_page"))
    return captures.join(known, (F.col("response.type") == "revisit") & (F.col("response.payload_digest") == F.col("digest"))
                         & (F.col("response.payload_bytes") == F.col("bytes")), "left") \
        .select("page_id", "response", "request", "metadata", F.col("first_page").alias("refers_to"))


def query(pages: DataFrame) -> DataFrame:
    """All pages written to archives and read back."""
    spark = pages.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write_archive(pages, path)
    return assemble(read_records(spark, path, with_payload=False)).select(
        "page_id", F.col("response.payload_bytes").alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"), F.col("response.type").alias("record_type"), "refers_to")


ORACLE_SQL = f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, n, min(page_id) AS first FROM p GROUP BY h, n),
b AS (SELECT *, list_transform(range(0, 8), lambda i: CAST('0x' || substr(h, 5 * i + 1, 5) AS INT)) AS v FROM p JOIN f USING (h, n))
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, array_to_string(list_transform(v, lambda x: array_to_string(list_transform(
    [15, 10, 5, 0], lambda s: substr('{BASE32}', ((x >> s) & 31) + 1, 1)), '')), '') AS payload_digest,
    CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> first THEN first END AS refers_to FROM b
"""
