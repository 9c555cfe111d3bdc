"""WARC archives: a writer with revisit records, and a reader that salvages what is left of damaged ones.

The writer makes each record a gzip member of its own. A payload that stands in several pages is stored once; the
others refer to it. The reader walks an archive once, in blocks, from check to check: a member must inflate and match
its CRC and size, a record must have its version line, headers, length, closing lines and digests. After a failed
check it searches for the next gzip member or version line and goes on there; the bytes between are logged as a quarantined
gap. So one damaged record costs that record only.

Archives are written by Spark's text writer, with its commit protocol, to any store that Spark reaches: a value is
the bytes of a member, and what ends a line is an empty member. They are listed by Spark and read by tasks through the file
systems of pyarrow, one archive in one task, as gzip can be cut nowhere else; the archives are as many as the writing
tasks.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, stored

#: Payloads of fewer bytes are stored each time.
LEAST_SHARED = 1000
VERSION, MEMBER = b"WARC/1.", b"\x1f\x8b\x08"
#: The format's own name for revisits of equal payloads.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes that are read at once, and most bytes of a record's headers.
BLOCK, HEADERS = 1 << 20, 1 << 16
TEXTS = ("fault", "record_type", "record_id", "target_uri", "date", "refers_to", "payload_digest")
SCHEMA = f"path string, offset long, length long, {', '.join(f'{c} string' for c in TEXTS)}, payload_bytes long, payload binary"


def zipped(data: bytes) -> bytes:
    """One gzip member."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def sha1(data: bytes) -> str:
    """A digest as archives write it."""
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(kind: str, record_id: str, block: bytes, more=(), date: str = "1970-01-01T00:00:00Z", content: str = "application/http; msgtype=response") -> bytes:
    """The bytes of one record. Line breaks in header values become spaces."""
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", date), *more, ("WARC-Block-Digest", sha1(block)), ("Content-Type", content), ("Content-Length", str(len(block)))]
    head = "".join(f"{k}: {re.sub(r'[\r\n]+', ' ', v)}\r\n" for k, v in fields if v is not None)
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def page_urn(page_id) -> str:
    return "urn:page:" + ("" if page_id is None else str(page_id))


def page_record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """A response with its payload, or a revisit whose HTTP header alone tells the payload's length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    about = [("WARC-Target-URI", url), ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())]
    if refers_to is None:
        return record("response", page_urn(page_id), http + payload, about)
    return record("revisit", page_urn(page_id), http, [*about, ("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{page_urn(refers_to)}>")])


def decided(pages: DataFrame, least: int = LEAST_SHARED) -> DataFrame:
    """(page_id, url, payload, digest, refers_to): refers_to is null where the payload is to be stored.

    Of equal payloads of at least ``least`` bytes, that with the largest page_id is stored. Only digests are gathered; the few
    that repeat meet the pages again by a join for which Spark chooses the way by their written size.
    """
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), F.sha1(payload).alias("digest"), F.octet_length(payload).alias("n"))
    shared = slim.filter(F.col("n") >= least).groupBy("digest").agg(F.count("*").alias("copies"), F.max("page_id").alias("first")).filter("copies > 1 and first is not null")
    shared = stored(shared.select("digest", "first"), "payloads")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"), F.sha1(payload).alias("digest"))
    rows = rows.join(shared, "digest", "left")
    return rows.select("page_id", "url", "payload", "digest", F.when(F.col("page_id").eqNullSafe(F.col("first")), None).otherwise(F.col("first")).alias("refers_to"))


def write(pages: DataFrame, path: str, least: int = LEAST_SHARED) -> None:
    """Writes archives of pages (page_id, url, html) to the folder ``path``, one a task.

    Each page gets a record, each archive an information record first. A null html is an empty payload, a null url leaves its
    header out. Of pages with equal ids and payloads each is a response. Pages without id revisit the page with
    the same payload that has one, and are responses where there is none. Other columns are left out; an empty
    table writes archives without pages. Htmls of any length are one record each.
    """

    def each(batches):
        yield pa.RecordBatch.from_pydict({"value": pa.array([zipped(record("warcinfo", "urn:uuid:" + str(uuid.UUID(int=0)), b"format: WARC File Format 1.1\r\n", content="application/warc-fields"))], pa.binary())})
        for batch in batches:
            held, size = [], 0
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                held.append(zipped(page_record(*row)))
                size += len(held[-1])
                if size >= BLOCK:
                    yield pa.RecordBatch.from_pydict({"value": pa.array(held, pa.binary())})
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_pydict({"value": pa.array(held, pa.binary())})

    members = decided(pages, least).select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(each, "value binary")
    # the bytes go out as they are; an empty member in a single-byte code ends each of them
    members.select(F.col("value").cast("string").alias("value")).write.option("lineSep", zipped(b"").decode("latin-1")).option("encoding", "ISO-8859-1").text(path)


class Blocks:
    """Bytes of a file or a member, read in blocks as they are asked for; what lies before ``drop`` is let go."""

    def __init__(self, read):
        self.read, self.buffer, self.start, self.ended = read, bytearray(), 0, False

    def fill(self, upto: int) -> bool:
        """Whether there are bytes up to ``upto``."""
        while not self.ended and self.start + len(self.buffer) < upto:
            block = self.read()
            self.ended = not block
            self.buffer += block
        return self.start + len(self.buffer) >= upto

    def get(self, start: int, end: int) -> bytes:
        self.fill(end)
        return bytes(self.buffer[start - self.start : end - self.start])

    def find(self, what: bytes, start: int, most: int) -> int:
        """Where ``what`` begins, from start and under start + most, else -1."""
        self.fill(start + most)
        at = self.buffer.find(what, start - self.start, start - self.start + most)
        return at if at < 0 else at + self.start

    def following(self, start: int) -> int:
        """The next place from ``start`` where a member or a version line begins, else the end."""
        while True:
            more = self.fill(start + BLOCK)
            found = [at for at in (self.buffer.find(x, start - self.start) for x in (VERSION, MEMBER)) if at >= 0]
            if found or not more:
                return self.start + min(found, default=len(self.buffer))
            start = self.start + len(self.buffer) - len(VERSION) + 1
            self.drop(start)

    def drop(self, upto: int) -> None:
        if upto - self.start > BLOCK:
            del self.buffer[: upto - self.start]
            self.start = upto


def _fields(head: bytes) -> dict[str, str]:
    lines = re.sub(rb"\r\n[ \t]+", b" ", head).split(b"\r\n")
    return {k.decode("utf-8", "replace").strip().lower(): v.decode("utf-8", "replace").strip() for k, _, v in (x.partition(b":") for x in lines)}


def _differs(said: str | None, found: bytes) -> bool:
    """Whether a digest of a kind known here is another one."""
    kind, _, value = (said or "").partition(":")
    if kind.lower() != "sha1" or not value:
        return False
    return value.upper() != base64.b32encode(found).decode() and value.lower() != found.hex()


def _record(stream: Blocks, at: int, size: int | None):
    """(end, record) of the record at ``at``, or (None, the check that failed)."""
    stop = stream.find(b"\r\n\r\n", at, HEADERS)
    if stop < 0:
        return None, "headers"
    version, _, head = stream.get(at, stop).partition(b"\r\n")
    fields = _fields(head)
    if not re.fullmatch(rb"WARC/1\.\d", version) or not re.fullmatch(r"[0-9]{1,18}", fields.get("content-length", "")):
        return None, "headers"
    begin, n = stop + 4, int(fields["content-length"])
    if size is not None and begin + n > size or not stream.fill(begin + n):
        return None, "length"
    if stream.get(begin + n, begin + n + 4) != b"\r\n\r\n":
        return None, "closing lines"
    block = stream.get(begin, begin + n)
    if _differs(fields.get("warc-block-digest"), hashlib.sha1(block).digest()):
        return None, "block digest"
    payload, length, kind = block, n, fields.get("warc-type")
    if fields.get("content-type", "").startswith("application/http"):
        http, _, payload = block.partition(b"\r\n\r\n")
        length = len(payload)
        if kind == "revisit":
            said = _fields(http).get("content-length", "")
            payload, length = None, int(said) if re.fullmatch(r"[0-9]{1,18}", said) else None
    found = hashlib.sha1(payload).digest() if kind != "revisit" else b""
    if found and _differs(fields.get("warc-payload-digest"), found):
        return None, "payload digest"
    bare = lambda x: x and x.strip("<>")
    said = fields.get("warc-payload-digest", "").partition(":")[2]
    digest = found.hex() if found else base64.b32decode(said).hex() if re.fullmatch("[A-Z2-7]{32}", said) else said.lower() or None
    it = {"record_type": kind, "record_id": bare(fields.get("warc-record-id")), "target_uri": bare(fields.get("warc-target-uri")), "date": fields.get("warc-date")}
    return begin + n + 4, it | {"refers_to": bare(fields.get("warc-refers-to")), "payload_digest": digest, "payload_bytes": length, "payload": payload}


def _member(stream: Blocks, at: int):
    """(end, content) of the gzip member at ``at``, or (None, the check that failed)."""
    z, parts, here = zlib.decompressobj(31), [], at
    try:
        while not z.eof:
            if not stream.fill(here + 1):
                return None, "member's end"
            block = stream.get(here, min(here + (1 << 16), stream.start + len(stream.buffer)))
            parts.append(z.decompress(block))
            here += len(block) - len(z.unused_data)
    except zlib.error:
        return None, "member"
    return here, b"".join(parts)


def salvage(stream: Blocks, size: int | None = None, inner: bool = False):
    """Records and gaps of an archive, in order: dictionaries with offset and length, and the failed check in a gap.

    A record inside a member has its member's place. A gap inside a member, whose other records are kept, too. Bytes
    between members or records that belong to none are a gap.
    """
    at, bad, why, end = 0, None, None, None
    while stream.fill(at + 1):
        head, found, end = stream.get(at, at + len(VERSION)), [], None
        if head == VERSION:
            end, it = _record(stream, at, size)
            found = [{"offset": at, "length": end - at, "fault": None} | it] if end else []
        elif head[: len(MEMBER)] == MEMBER and not inner:
            end, it = _member(stream, at)
            if end:
                source = [it]
                found = [x | {"offset": at, "length": end - at} for x in salvage(Blocks(lambda: source.pop() if source else b""), len(it), True)]
        else:
            it = "version line"
        if end:
            if bad is not None:
                yield {"offset": bad, "length": at - bad, "fault": why}
                bad = None
            yield from found
            at = end
        else:
            if bad is None:
                bad, why = at, it
            at = stream.following(at + 1)
        stream.drop(at)
    if bad is not None and at > bad:
        yield {"offset": bad, "length": at - bad, "fault": why}


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records and quarantined gaps of all archives in a folder: SCHEMA. ``fault`` is null for a record; for a gap it is the check that failed.

    Records stand alone or in gzip members, one or more in each. Payloads are left null if not asked for; digest and
    length are of the full payload all the same. Digests are lower-case hex. Truncated and empty archives give what
    can be read of them; a folder without archives gives no rows. A record is held in memory whole.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    many = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def each(batches):
        longs = lambda *names: [(c, pa.int64()) for c in names]
        schema = pa.schema([("path", pa.string()), *longs("offset", "length"), *[(c, pa.string()) for c in TEXTS], *longs("payload_bytes"), ("payload", pa.binary())])
        for batch in batches:
            for name, size in zip(*(c.to_pylist() for c in batch.columns)):
                system, at = pa.fs.FileSystem.from_uri(name if "://" in name else re.sub("^file:/+", "file:///", name))
                with system.open_input_stream(at, compression=None) as file:
                    held, bytes_held = [], 0
                    for row in salvage(Blocks(lambda: file.read(BLOCK)), size):
                        if not payloads:
                            row.pop("payload", None)
                        held.append({"path": name} | row)
                        bytes_held += len(row.get("payload") or b"") + 200
                        if bytes_held >= BLOCK:
                            yield pa.RecordBatch.from_pylist(held, schema)
                            held, bytes_held = [], 0
                    if held:
                        yield pa.RecordBatch.from_pylist(held, schema)

    return files.repartition(many).mapInArrow(each, SCHEMA)


def pages_of(records: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of the page records of ``read``."""
    number = lambda c: F.expr(f"try_cast(nullif(substring({c}, {len(page_urn(None)) + 1}), '') as bigint)")
    rows = records.filter("fault is null and record_type in ('response', 'revisit')")
    return rows.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark).rstrip('/')}/archives-{uuid.uuid4().hex}"
    write(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return pages_of(read(spark, path, payloads=False))


OP12_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, ''))::BIGINT AS n FROM pages),
f AS (SELECT *, CASE WHEN n >= {LEAST_SHARED} AND count(*) OVER (PARTITION BY html) > 1 THEN max(page_id) OVER (PARTITION BY html) END AS first FROM p)
SELECT page_id, n AS payload_bytes, sha1(html) AS payload_digest, CASE WHEN first IS NULL OR first IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first IS DISTINCT FROM page_id THEN first END AS refers_to
FROM f
"""
