import gzip
import hashlib
import io
import zlib

from inkloom.llm.warc import _MAGIC, members, parse, read_warc, write_warc

PAGES = [(1, "http://a/ü x", "<p>" + "same " * 40), (2, None, "<p>" + "same " * 40), (3, "c", None), (4, "d", ""), (5, "e", "small"), (6, "f", "small"),
         (7, "g", "日本" * 50), (7, "g", "日本" * 50), (None, "h", "<p>" + "same " * 40), (8, "i", "x" * 300_000)]


def test_records_come_back_for_any_split(spark, tmp_path):
    path = f"{tmp_path}/warc"
    write_warc(spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(3), path)
    want = []
    for i, _, html in PAGES:
        raw = (html or "").encode()
        same = [p[0] for p in PAGES if (p[2] or "").encode() == raw and p[0] is not None]
        head = min(same) if len(raw) >= 100 and same else None
        revisit = head is not None and (i is None or i > head)
        want.append((None if i is None else str(i), len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", str(head) if revisit else None))
    for split in (50, 1 << 20):
        rows = read_warc(spark, path, split_bytes=split).collect()
        got = [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in rows]
        assert sorted(map(str, got)) == sorted(map(str, want))
        assert {bytes(r["payload"]) for r in rows if r["record_type"] == "response"} == {(p[2] or "").encode() for p in PAGES}
    for f in tmp_path.glob("warc/part-*"):  # any gzip reader reads the files whole
        assert gzip.decompress(f.read_bytes()).count(b"WARC/1.1\r\n") >= 1


def member(payload, level=6):
    raw = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:inkloom:page:1>\r\nWARC-Target-URI: a\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(payload), payload)
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def test_magic_inside_members_is_passed_over_and_ranges_own_what_starts_in_them():
    other = zlib.compressobj(0, zlib.DEFLATED, 31)
    decoy = other.compress(b"no archive") + other.flush()
    parts = [member(b"x\r\n\r\n" + _MAGIC * 5 + decoy, 0), member(b"y\r\n\r\nb" * 400), decoy, member(b"z\r\n\r\nc")]
    data = b"".join(parts)
    for step in (1, 7, 64, len(data)):
        got = [m for at in range(0, len(data), step) for m in members(io.BytesIO(data), at, at + step)]
        assert len(got) == 3
    assert parse(member_content(parts[3]))["record_type"] == "response"


def member_content(raw):
    return next(members(io.BytesIO(raw), 0, len(raw)))


def test_no_pages(spark, tmp_path):
    write_warc(spark.createDataFrame([], "page_id long, url string, html string"), f"{tmp_path}/none")
    assert read_warc(spark, f"{tmp_path}/none").count() == 0
