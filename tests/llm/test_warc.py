"""Archives: written and read back, and what is salvaged of damaged ones."""

import gzip
import hashlib
import os
import random

import pytest

from narrata.llm import warc as op
from narrata.llm.common import shared_dir

SCHEMA = "page_id long, url string, html string, digest string, first long, payload string"


def scanned(data, size=True):
    parts = [data[i : i + 1000] for i in range(0, len(data), 1000)]
    return list(op.salvage(op.Blocks(lambda: parts.pop(0) if parts else b""), len(data) if size else None))


def page(i, payload, refers_to=None):
    return op.page_record(i, f"http://host/{i}", payload, hashlib.sha1(payload).hexdigest(), refers_to)


def brute(rows):
    """What the query returns for rows (page_id, html)."""
    rows = [(i, (h or "").encode()) for i, h in rows]
    out = []
    for i, p in rows:
        same = [j for j, q in rows if q == p]
        ids = [j for j in same if j is not None]
        to = max(ids) if len(p) >= 1000 and len(same) > 1 and ids else None
        to = None if to == i else to
        out.append((i, len(p), hashlib.sha1(p).hexdigest(), "response" if to is None else "revisit", to))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def pages():
    rng = random.Random(2)
    long = "".join(rng.choice("abc é\r\n") for _ in range(1500))
    htmls = [None, "", "short", "short", long, long, long, "x" * 999, "x" * 999, "y" * 1000, "y" * 1000, "WARC/1.1\r\nWARC-Type: response\r\n\r\n" * 40, "\x1f\x8b\x08" * 500, "😀" * 400_000, "z" * 2000]
    rows = [(i * 3, f"http://h/{i}" if i % 4 else None, h) for i, h in enumerate(htmls)]
    return rows + [rows[4], (None, "http://none\r\nX: y", long), (None, "u", "only nulls " * 200), (None, "u", "only nulls " * 200), (-7, "u", long)]


def test_round_trip(spark, pages):
    df = spark.createDataFrame([(*r, "d", 1, "p") for r in pages], SCHEMA).repartition(3)
    path = f"{shared_dir(spark)}/warc-test-{os.getpid()}"
    op.write(df, path)
    records = op.read(spark, path)
    assert records.filter("fault is not null").count() == 0
    got = sorted((tuple(r) for r in op.pages_of(records).collect()), key=str)
    assert got == brute([(i, h) for i, _, h in pages])
    # payloads come back byte by byte, and any gzip reader can read the archives
    kept = {r.record_id: bytes(r.payload) for r in records.filter("record_type = 'response'").collect()}
    assert kept["urn:page:39"].decode() == "😀" * 400_000 and kept["urn:page:33"].decode() == pages[11][2]
    for r in records.select("path").distinct().collect():
        assert gzip.decompress(open(r.path.removeprefix("file:"), "rb").read()).startswith(b"WARC/1.1\r\n")


def test_plain_and_zipped_and_mixed_archives():
    records = [page(i, f"<p>{i}</p>".encode() * 50) for i in range(6)]
    plain, zipped = b"".join(records), b"".join(map(op.zipped, records))
    for data in (plain, zipped, plain + zipped, op.zipped(plain), op.zipped(b"") + zipped + op.zipped(b"")):
        found = scanned(data)
        assert all(x["fault"] is None for x in found) and len(found) == len(records) * (1 + (len(data) == len(plain + zipped)))
    assert scanned(b"") == []


def test_every_damaged_byte_costs_one_record():
    """Whatever byte is changed, the other records come back, and gaps and records cover the archive."""
    records = [page(i, bytes(random.Random(i).randrange(32, 90) for _ in range(120))) for i in range(4)]
    for wrap in (op.zipped, bytes):
        members = [wrap(r) for r in records]
        whole = b"".join(members)
        edges = [sum(map(len, members[:k])) for k in range(5)]
        for at in range(0, len(whole), 3):
            data = bytearray(whole)
            data[at] ^= 0x15
            hurt = next(k for k in range(4) if at < edges[k + 1])
            found = scanned(bytes(data))
            ids = {x["record_id"] for x in found if x["fault"] is None}
            assert {f"urn:page:{k}" for k in range(4) if k != hurt} <= ids, (wrap, at)
            assert sum(x["length"] for x in found) == len(data)
            covered = sorted((x["offset"], x["offset"] + x["length"]) for x in found)
            assert covered[0][0] == 0 and all(a[1] == b[0] for a, b in zip(covered, covered[1:]))


def test_gaps_are_logged_with_their_places():
    a, b, c = (op.zipped(page(i, b"payload %d " % i * 30)) for i in range(3))
    found = scanned(a + b"junk WARC/1.0 junk \x1f\x8b\x08 " + b[:-9] + c)
    gaps = [x for x in found if x["fault"]]
    assert [x["record_id"] for x in found if x["fault"] is None] == ["urn:page:0", "urn:page:2"]
    assert [(x["offset"], x["length"], x["fault"]) for x in gaps] == [(len(a), len(b) - 9 + 23, "version line")]
    # cut off at the end, and a length that claims more than there is
    assert [x["fault"] for x in scanned(a + b[:-1])] == [None, "member's end"]
    lying = page(5, b"x" * 40).replace(b"Content-Length: 40", b"Content-Length: 99999999", 1).replace(b"Content-Length: 1", b"Content-Length: 9")
    for sized in (True, False):
        assert [x["record_id"] for x in scanned(lying + page(6, b"fine"), sized) if x["fault"] is None] == ["urn:page:6"]


def test_damage_within_a_member_of_many_records():
    records = [page(i, b"payload %d " % i * 30) for i in range(3)]
    inner = records[0] + records[1].replace(b"payload 1 payload", b"payload 1 pay.oad", 1) + records[2]
    found = scanned(op.zipped(inner))
    assert [x.get("record_id") for x in found if x["fault"] is None] == ["urn:page:0", "urn:page:2"]
    assert [x["fault"] for x in found if x["fault"]] == ["block digest"]


def test_foreign_records():
    """Folded headers, no digests, hexadecimal ones, and kinds without HTTP."""
    block = b"hello"
    bare = b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: <http://x/\r\n  y>\r\nWARC-Record-ID: <urn:a>\r\nContent-Type: text/plain\r\nContent-Length: 5\r\nWARC-Block-Digest: sha1:" + hashlib.sha1(block).hexdigest().encode() + b"\r\n\r\nhello\r\n\r\n"
    (one,) = scanned(bare)
    assert one["fault"] is None and one["payload"] == b"hello" and one["payload_digest"] == hashlib.sha1(block).hexdigest() and one["target_uri"] == "http://x/ y"
    (one,) = scanned(bare.replace(b"sha1:", b"md5:"))
    assert one["fault"] is None
    assert scanned(bare.replace(b"hello\r\n\r\n", b"hullo\r\n\r\n"))[0]["fault"] == "block digest"


def test_damaged_files_in_a_folder(spark, tmp_path):
    records = [op.zipped(page(i, b"payload %d " % i * 200)) for i in range(40)]
    whole = b"".join(records)
    cut = bytearray(whole)
    cut[len(whole) // 2 : len(whole) // 2 + 60] = b"\0" * 60
    (tmp_path / "a.warc.gz").write_bytes(whole)
    (tmp_path / "b.warc.gz").write_bytes(bytes(cut))
    (tmp_path / "empty.warc.gz").write_bytes(b"")
    (tmp_path / "noise.bin").write_bytes(b"\x1f\x8b\x08" * 100_000)
    found = op.read(spark, str(tmp_path), payloads=False).collect()
    by = lambda name: [x for x in found if x.path.endswith(name)]
    assert len(by("a.warc.gz")) == 40 and all(x.fault is None and x.payload is None for x in by("a.warc.gz"))
    assert 38 <= sum(x.fault is None for x in by("b.warc.gz")) < 40 and sum(x.length for x in by("b.warc.gz")) == len(cut)
    assert by("empty.warc.gz") == [] and [x.length for x in by("noise.bin")] == [300_000]


def test_empty_table(spark):
    path = f"{shared_dir(spark)}/warc-empty-{os.getpid()}"
    op.write(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert op.pages_of(op.read(spark, path)).count() == 0
