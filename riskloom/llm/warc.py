"""WARC archives: a writer with revisit records, and a salvage reader.

The writer makes one gzip member per record and joins members to archives of bounded size.  Records with equal
payloads share one ``response`` (the largest page_id); the others are ``revisit`` records that refer to it.  The reader
checks every member (gzip CRC), record (lengths, block digest) in turn; where a check fails it searches for the next member
or version line that reads well, goes on there, and logs the bytes in between as a quarantined gap.  Sound records beside
a bad one in a member, or before a member's damage, are kept.

Archives are rows (archive, data) of a Parquet folder, so that any store Spark can write holds them; archives that are files
are read with Spark's ``binaryFile`` source.

Edge cases: null html is an empty payload; a null page_id ranks below every other and is written as ``null``; rows that
repeat page_id and payload are one capture and all ``response`` if the id is the largest; an empty table gives no archive.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .common import only

ARCHIVE_BYTES = 4 << 20
STEP = 1 << 12             # compressed bytes read at a time
MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1."
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DIGESTS = {"md5", "sha1", "sha256", "sha384", "sha512"}
#: names of fields as they are written; other writers' letter case is brought to it
FIELDS = ["WARC-Type", "WARC-Record-ID", "WARC-Date", "WARC-Target-URI", "WARC-Payload-Digest", "WARC-Block-Digest", "WARC-Refers-To", "WARC-Profile", "Content-Type", "Content-Length"]
_NAMES = {f.lower(): f for f in FIELDS}
STAMP = "1970-01-01T00:00:00Z"       # pages carry no capture time


def sha1_32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def digest_holds(value: str | None, data: bytes) -> bool | None:
    """Whether a labelled digest (``sha1:...``, in base32, hex or base64) is that of ``data``; None without one, or of an unknown algorithm."""
    name, _, text = (value or "").strip().partition(":")
    if name.lower().replace("-", "") not in DIGESTS:
        return None
    raw = hashlib.new(name.lower().replace("-", ""), data).digest()
    return text.lower() == raw.hex() or text.rstrip("=") in (base64.b32encode(raw).decode().rstrip("="), base64.b64encode(raw).decode().rstrip("="))


def record_id(page_id) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def page_of(urn: str | None):
    if not urn or not urn.startswith("<urn:page:"):
        return None
    tail = urn[len("<urn:page:"):-1]
    return None if tail == "null" else int(tail)


def record(page_id, url: str | None, payload: bytes, refers_to=None, revisit: bool = False) -> bytes:
    """One WARC/1.1 record; a revisit keeps the HTTP head (with the payload's length) and drops the payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", STAMP),
              ("WARC-Target-URI", "".join(c for c in url or "about:blank" if c >= " ")), ("WARC-Payload-Digest", "sha1:" + sha1_32(payload)), ("WARC-Block-Digest", "sha1:" + sha1_32(block)),
              ("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    if revisit:
        fields += [("WARC-Refers-To", record_id(refers_to)), ("WARC-Profile", PROFILE)]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


# ---------------------------------------------------------------- reading

class Bad(Exception):
    """A member or record that fails a check."""


def parse(data: bytes, at: int) -> tuple[dict, bytes, int]:
    """(fields, block, end) of the record at ``at``."""
    if not data.startswith(VERSION, at):
        raise Bad("no version line")
    stop = data.find(b"\r\n\r\n", at)
    if stop < 0:
        raise Bad("unfinished head")
    try:
        lines = data[at:stop].decode("utf-8").split("\r\n")[1:]
        pairs = [line.split(":", 1) for line in lines]
        fields = {_NAMES.get(k.strip().lower(), k.strip()): v.strip() for k, v in pairs}
        size = int(fields["Content-Length"])
    except (UnicodeDecodeError, ValueError, KeyError) as e:
        raise Bad("bad head") from e
    begin = stop + 4
    block = data[begin:begin + size]
    end = begin + size + 4
    if size < 0 or len(block) < size or data[begin + size:end] != b"\r\n\r\n":
        raise Bad("bad length")
    if digest_holds(fields.get("WARC-Block-Digest"), block) is False:
        raise Bad("bad block digest")
    return fields, block, end


def _member(data: bytes, at: int) -> tuple[bytes, int, str | None]:
    """(content, end, failed check) of the gzip member at ``at``; of a damaged one, the content before the damage."""
    z, out, k = zlib.decompressobj(31), [], at
    while k < len(data) and not z.eof:
        try:
            out.append(z.decompress(data[k:k + STEP]))
        except zlib.error:
            return b"".join(out), k, "bad member"
        k += STEP
    content = b"".join(out)
    return (content, min(k, len(data)) - len(z.unused_data), None) if z.eof else (content, len(data), "unfinished member")


def _records(data: bytes):
    """Yield ("record", offset, fields, block) and ("gap", start, stop, reason) over uncompressed records."""
    at = 0
    while at < len(data):
        try:
            fields, block, end = parse(data, at)
            yield "record", at, fields, block
        except Bad as e:
            end = at + 1
            while end < len(data):                     # the next version line of a record that reads well
                end = data.find(VERSION, end)
                end = len(data) if end < 0 else end
                try:
                    parse(data, end)
                    break
                except Bad:
                    end += 1
            end = min(end, len(data))
            yield "gap", at, end, str(e)
        at = end


def salvage(data: bytes):
    """Yield ("record", offset, fields, block) and ("gap", start, stop, reason) over a whole archive.

    Offsets are the archive's; a member's records have the member's.  A record that fails inside a sound member is a gap of that
    member, with its place in the content as the reason, and the member's other records stay.  Of a damaged member, records
    before the damage stay if their block digest holds, and the member is a gap.
    """
    at, n = 0, len(data)
    while at < n:
        if data.startswith(MAGIC, at):
            content, end, failed = _member(data, at)
            for kind, a, x, y in _records(content):
                if kind == "record" and (failed is None or digest_holds(x.get("WARC-Block-Digest"), y)):
                    yield "record", at, x, y
                elif kind == "gap" and failed is None:
                    yield "gap", at, end, f"{y} in bytes {a}-{x} of the member"
        else:
            try:
                fields, block, end = parse(data, at)
                failed = None
                yield "record", at, fields, block
            except Bad as e:
                failed = str(e)
        if failed is not None:
            end = _resume(data, at + 1)
            yield "gap", at, end, failed
        at = end


def _resume(data: bytes, at: int) -> int:
    """The next offset at which a record reads well, or a member with a record: any record if the member is sound, else one before its
    damage whose block digest holds (else the end)."""
    while True:
        ends = [k for k in (data.find(MAGIC, at), data.find(VERSION, at)) if k >= 0]
        if not ends:
            return len(data)
        k = min(ends)
        if data.startswith(MAGIC, k):
            content, _, failed = _member(data, k)
            if any(kind == "record" and (failed is None or digest_holds(x.get("WARC-Block-Digest"), y)) for kind, _, x, y in _records(content)):
                return k
        else:
            try:
                parse(data, k)
                return k
            except Bad:
                pass
        at = k + 1


# ---------------------------------------------------------------- Spark

def plan_records(pages: DataFrame) -> DataFrame:
    """``pages`` with the digest of the payload, and the page that holds it.

    The largest page_id of a payload comes from a partially aggregated max; a payload's rows then meet it in an equi-join
    that AQE can split, however many rows share the payload.
    """
    rows = only(pages, page_id="bigint", url="string", html="string").withColumn("html", F.coalesce("html", F.lit("")))
    rows = rows.withColumns({"digest": F.sha1(F.col("html").cast("binary")), "size": F.octet_length("html")})
    largest = rows.groupBy("digest", "size").agg(F.max("page_id").alias("holder"))
    return rows.join(largest, ["digest", "size"]).select(
        "page_id", "url", "html", "holder", (~F.col("page_id").eqNullSafe(F.col("holder"))).alias("revisit"))


def write(pages: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write a record per page to archives in the Parquet folder ``path``: (archive, data)."""
    out = pa.schema([("archive", pa.string()), ("data", pa.binary())])

    def run(batches):
        from pyspark import TaskContext

        part, k, held, size = TaskContext.get().partitionId(), 0, [], 0

        def close():
            return pa.record_batch([pa.array([f"part-{part:05d}-{k:05d}.warc.gz"]), pa.array([b"".join(held)], pa.binary())], schema=out)

        for batch in batches:
            cols = [batch.column(c) for c in ("page_id", "url", "html", "holder", "revisit")]
            for i in range(batch.num_rows):
                page, url, html, holder, revisit = (c[i].as_py() for c in cols)
                held.append(gzip.compress(record(page, url, html.encode(), holder, revisit), 6, mtime=0))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield close()
                    held.clear()
                    k, size = k + 1, 0
        if held:
            yield close()

    plan_records(pages).mapInArrow(run, "archive string, data binary").write.mode("errorifexists").parquet(path)


def load(spark: SparkSession, path: str, files: bool = False) -> DataFrame:
    """(archive, data) of a folder that ``write`` made, or of archive files."""
    if files:
        return spark.read.format("binaryFile").load(path).select(F.col("path").alias("archive"), F.col("content").alias("data"))
    return spark.read.schema("archive string, data binary").parquet(path)


def read(archives: DataFrame) -> DataFrame:
    """Records and quarantined gaps of ``archives(archive, data)``.

    kind is ``record`` or ``gap``; a record's payload_ok tells whether a response's payload has its digest.
    """
    schema = ("archive string, kind string, offset bigint, stop bigint, reason string, page_id bigint, record_type string, refers_to bigint, "
              "url string, payload_bytes bigint, payload_digest string, payload_ok boolean, payload binary")
    out = pa.schema([("archive", pa.string()), ("kind", pa.string()), ("offset", pa.int64()), ("stop", pa.int64()), ("reason", pa.string()), ("page_id", pa.int64()),
                     ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                     ("payload_ok", pa.bool_()), ("payload", pa.binary())])

    def rows(name, data):
        for kind, at, x, y in salvage(data):
            if kind == "gap":
                yield (name, "gap", at, x, y, *[None] * 8)
                continue
            head, _, payload = y.partition(b"\r\n\r\n")
            length = [v for k, _, v in (h.partition(b": ") for h in head.split(b"\r\n")) if k.lower() == b"content-length"]
            revisit = x.get("WARC-Type") == "revisit"
            size = int(length[0]) if revisit and length and length[0].isdigit() else len(payload)
            whole = x.get("WARC-Payload-Digest", "")
            digest = whole.removeprefix("sha1:")
            yield (name, "record", at, None, None, page_of(x.get("WARC-Record-ID")), x.get("WARC-Type"), page_of(x.get("WARC-Refers-To")), x.get("WARC-Target-URI"),
                   size, digest, None if revisit else digest_holds(whole, payload), None if revisit else payload)

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                held, size = [], 0
                for r in rows(batch.column("archive")[i].as_py(), batch.column("data")[i].as_py() or b""):
                    held.append(r)
                    size += len(r[-1] or b"")
                    if size >= ARCHIVE_BYTES:
                        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), out, strict=True)], schema=out)
                        held, size = [], 0
                if held:
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), out, strict=True)], schema=out)

    return archives.select("archive", "data").mapInArrow(run, schema)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to archives under the shared checkpoint folder and read them back: a row per record."""
    spark = pages.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write(pages, path)
    return (read(load(spark, path)).filter("kind = 'record'")
            .select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))
