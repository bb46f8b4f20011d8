"""WARC archives: a writer with revisit records and a splittable reader.

Writing: each page becomes one gzip member. Spark's own text writer puts the members into files, so commits, retries and
every file system Spark writes to work as usual. It ends each row with a separator of at least one character; a gzip member
ends with the high byte of its length, which is 0 below 16 MiB, so that byte is left to the separator U+0000. Larger
members keep theirs and are followed by one zero byte, which gzip readers skip as padding.

Reading: tasks get byte ranges of files. A task looks for the gzip magic in its range, tries each place by decoding the
first bytes, goes on where they hold a WARC version line, and owns all records that start inside its range; the last one is
read to its end beyond the range. Places inside compressed data that only look like a member are passed over.

Defined cases: null payloads are empty; null urls give an empty target; a null page id gives an empty id, comes back as
null and is the response of its payload only if all ids of that payload are null; rows that share the smallest id of a
payload are all responses; an empty table gives no archive records; further columns are not stored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .store import shared_path, stored, table
from .words import map_batches

MIN_REVISIT_BYTES = 100
SPLIT_BYTES = 16 << 20
_READ = 1 << 20
_MAGIC = b"\x1f\x8b\x08"
_VERSION = b"WARC/1."
_ID = "urn:inkloom:page:"


def mark_revisits(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """(page_id, url, html, digest, refers_to): refers_to names the smallest id with the same payload, null for responses.

    Only digests that occur twice are joined, and only ids travel in that join; payloads move once, by id.
    """
    html = F.coalesce("html", F.lit(""))
    base = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), html.alias("html"), F.sha2(html, 256).alias("digest"))
    big = base.where(F.octet_length("html") >= min_bytes).select("page_id", "digest")
    heads = stored(big.groupBy("digest").agg(F.min("page_id").alias("head"), F.count(F.lit(1)).alias("_n"))
                   .where("_n > 1 AND head IS NOT NULL").select("digest", "head"), "heads")
    later = stored(big.join(heads, "digest").where("page_id IS NULL OR page_id > head").select("page_id", "digest", "head").distinct(), "later")
    key = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    return base.withColumn("_k", key).join(later.select(key.alias("_k"), "digest", F.col("head").alias("refers_to")), ["_k", "digest"], "left").drop("_k")


def _record(page_id, url: str, html: bytes, digest: str, refers_to, date: str, level: int) -> bytes:
    kind = "response" if refers_to is None else "revisit"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http + (html if refers_to is None else b"")
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <{_ID}{'' if page_id is None else page_id}>", f"WARC-Date: {date}",
            f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%-._~')}", f"WARC-Payload-Digest: sha256:{digest}",
            f"X-Payload-Length: {len(html)}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{_ID}{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    raw = b"WARC/1.1\r\n" + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    member = packer.compress(raw) + packer.flush()
    return member[:-1] if member[-1] == 0 else member


def write_warc(pages: DataFrame, path: str, *, date: str = "1970-01-01T00:00:00Z", level: int = 4, min_bytes: int = MIN_REVISIT_BYTES) -> None:
    """Archives of ``pages`` (page_id, url, html) under ``path``, one gzip member a record."""
    schema = T.StructType([T.StructField("member", T.BinaryType())])
    arrow = to_arrow_schema(schema)

    def run(batch):
        rows = zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to")))
        yield pa.RecordBatch.from_arrays([pa.array([_record(i, u, h, d, r, date, level) for i, u, h, d, r in rows], pa.binary())], schema=arrow)

    marked = mark_revisits(pages, min_bytes).select("page_id", "url", F.encode("html", "UTF-8").alias("html"), "digest", "refers_to")
    map_batches(marked, run, schema).select(F.col("member").cast("string").alias("value")).write.option("lineSep", "\u0000").text(path)


class _Range:
    """Bytes of a file from ``start`` on, read as they are needed."""

    def __init__(self, handle, start: int):
        self.handle, self.base, self.data = handle, start, b""
        handle.seek(start)

    def more(self) -> bool:
        got = self.handle.read(_READ)
        self.data += got
        return bool(got)

    def drop(self, n: int) -> None:
        self.base, self.data = self.base + n, self.data[n:]


def _decode(src: _Range, at: int) -> tuple[bytes, int] | None:
    """(content, length) of the gzip member at offset ``at`` of the buffer, None if no WARC member stands there."""
    unpack, out, fed = zlib.decompressobj(31), bytearray(), at
    try:
        while not unpack.eof:
            if fed == len(src.data) and not src.more():
                return None
            piece = src.data[fed:fed + (512 if not out else _READ)]
            fed += len(piece)
            out += unpack.decompress(piece)
            if len(out) >= len(_VERSION) and not out.startswith(_VERSION):
                return None
    except zlib.error:
        return None
    if not out.startswith(_VERSION):
        return None
    return bytes(out), fed - len(unpack.unused_data) - at


def members(handle, start: int, end: int) -> Iterator[bytes]:
    """Contents of the members that start in [start, end)."""
    src, at = _Range(handle, start), 0
    while True:
        while (found := src.data.find(_MAGIC, at)) < 0:
            keep = max(at, len(src.data) - len(_MAGIC) + 1)
            src.drop(keep)
            at = 0
            if src.base >= end or not src.more():
                return
        if src.base + found >= end:
            return
        got = _decode(src, found)
        if got is None:
            at = found + 1
        else:
            yield got[0]
            src.drop(found + got[1])
            at = 0


def parse(content: bytes) -> dict:
    """Fields of one record."""
    head, _, rest = content.partition(b"\r\n\r\n")
    fields = {}
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        fields[name.decode().lower()] = value.strip().decode()
    block = rest[:int(fields["content-length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    revisit = fields["warc-type"] == "revisit"
    number = lambda name: fields.get(name, "").strip("<>").removeprefix(_ID) or None
    return {"page_id": number("warc-record-id"), "url": unquote(fields["warc-target-uri"]), "record_type": fields["warc-type"],
            "refers_to": number("warc-refers-to"),
            "payload_digest": fields["warc-payload-digest"].removeprefix("sha256:") if revisit else hashlib.sha256(payload).hexdigest(),
            "payload_bytes": int(fields["x-payload-length"]) if revisit else len(payload), "payload": None if revisit else payload}


def read_warc(spark: SparkSession, path: str, *, split_bytes: int = SPLIT_BYTES, payload: bool = True) -> DataFrame:
    """(page_id, url, record_type, refers_to, payload_digest, payload_bytes[, payload]) of all records under ``path``.

    Ids come back as strings. Digest and length of a response are those of its decoded payload; a revisit tells both.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length").where("length > 0")
    splits = files.select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(split_bytes).cast("long"))).alias("start")) \
        .withColumn("end", F.col("start") + split_bytes)
    n = files.agg(F.sum(F.ceil(F.col("length") / split_bytes))).first()[0] or 1
    names = ["page_id", "url", "record_type", "refers_to", "payload_digest"]
    schema = T.StructType([T.StructField(c, T.StringType()) for c in names] + [T.StructField("payload_bytes", T.LongType())]
                          + [T.StructField("payload", T.BinaryType())] * payload)
    arrow = to_arrow_schema(schema)

    def run(batch):
        for uri, start, end in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "end"))):
            fs, inner = pafs.FileSystem.from_uri(uri)
            with fs.open_input_file(inner) as handle:
                rows, held = [], 0
                for content in members(handle, start, end):
                    rows.append(parse(content))
                    held += len(content)
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return map_batches(splits.repartition(int(n), "path", "start"), run, schema)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    back = read_warc(spark, path, payload=False)
    return back.select(F.col("page_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                       F.col("refers_to").cast("long").alias("refers_to"))


OP5_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, sha256(html) AS payload_digest FROM p),
h AS (SELECT payload_digest, min(page_id) AS head FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT d.page_id, CAST(d.payload_bytes AS BIGINT) AS payload_bytes, d.payload_digest,
       CASE WHEN h.head IS NULL OR d.page_id <= h.head THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN d.page_id > h.head THEN h.head END AS refers_to
FROM d LEFT JOIN h ON h.payload_digest = d.payload_digest AND d.payload_bytes >= 100
"""
