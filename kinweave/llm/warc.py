"""WARC archives: a writer with revisit records and a splittable reader.

Each record is a gzip member of its own. The reader cuts files into byte ranges; a task looks for gzip magic from
the start of its range, decodes the candidate in whole and takes it for a record if its text opens as a WARC header,
its checksum holds and a member or the end of the file follows. From there it goes from member to member, and owns
those that start inside its range, however far they reach. It decodes the first member behind its own as well, and a
file's first range expects a record at byte 0: so a damaged record is an error wherever ranges are cut, though a task
that searches a range passes over it. No range needs to know of another, and each record is read once.

Payloads are UTF-8 texts; null counts as empty. Of equal payloads (by SHA-1 and length) of ``REVISIT_BYTES`` bytes or
more, the row of the largest id is the response and the others revisit it; a null id is smaller than all others;
rows that repeat the largest id are responses too. A null URL gives no target. Columns of pages other than id, URL and
text have no place in a record and are left out; an empty table gives no file, and no rows when read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .files import created, deleted, listed, moved, reader

REVISIT_BYTES = 1000
FILE_BYTES, SPLIT_BYTES = 1 << 30, 1 << 23
MAGIC = b"\x1f\x8b\x08"
_READ = 1 << 18
_NO_ID = -(2**63)
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_PAGE = "urn:x-page:"


# --- records -------------------------------------------------------------------------------------


def record(kind: str, ident: str, url: str | None, digest: str, payload: bytes, size: int, date: str, refers_to: str | None = None) -> bytes:
    """The bytes of one record; a revisit keeps the HTTP header and leaves the payload out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{ident}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    head.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{refers_to}>", f"WARC-Profile: {_PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def parse(data: bytes) -> dict:
    """Fields of a record; payload is None for a revisit."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = re.search(rb"(?im)^content-length:\s*(\d+)", http)
    digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
    revisit = fields["warc-type"] == "revisit"
    if not revisit and hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError(f"{fields['warc-record-id']}: the payload does not have its digest")
    return {"record_id": fields["warc-record-id"].strip("<>"), "record_type": fields["warc-type"], "target_uri": fields.get("warc-target-uri"), "refers_to": fields["warc-refers-to"].strip("<>") if "warc-refers-to" in fields else None, "payload_digest": digest, "payload_bytes": int(size[1]) if size else len(payload), "payload": None if revisit else payload}


class Members:
    """Reads gzip members of a file by offset, holding a window of it."""

    def __init__(self, uri: str):
        self.file, self.at, self.held = reader(uri), 0, b""
        self.size = self.file.size()

    def read(self, at: int, n: int) -> bytes:
        if at < self.at or at + n > self.at + len(self.held):
            self.at, self.held = at, self.file.read_at(min(max(n, _READ), self.size - at), at)
        return self.held[at - self.at : at - self.at + n]

    def find(self, at: int, end: int) -> int | None:
        """The first magic that starts in [at, end)."""
        while at < end:
            part = self.read(at, min(_READ, self.size - at))
            if (k := part.find(MAGIC)) >= 0:
                return at + k if at + k < end else None
            if at + len(part) >= self.size:
                return None
            at += len(part) - len(MAGIC) + 1
        return None

    def decode(self, at: int) -> tuple[bytes, int] | None:
        """The record in the member at an offset and the offset behind it; None if none starts there."""
        d, out, opened = zlib.decompressobj(31), [], False
        try:
            while not d.eof:
                part = self.read(at, min(_READ, self.size - at))
                if not part:
                    return None
                out.append(d.decompress(part))
                at += len(part) - len(d.unused_data)
                if not opened and sum(map(len, out)) >= 5:
                    opened = True
                    if not b"".join(out).startswith(b"WARC/"):
                        return None
        except zlib.error:
            return None
        if not opened or at < self.size and self.read(at, min(3, self.size - at)) != MAGIC:
            return None
        return b"".join(out), at


def records(uri: str, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(offset, bytes) of the records that start in [start, end)."""
    m = Members(uri)
    end = min(end, m.size)
    at = m.find(start, end) if start else 0 if end else None
    while start and at is not None and m.decode(at) is None:
        at = m.find(at + 1, end)
    while at is not None and at < m.size:
        if (found := m.decode(at)) is None:
            raise ValueError(f"{uri}: a damaged record at byte {at}")
        if at >= end:
            return  # the next range's first record is sound: it will be found there
        yield at, found[0]
        at = found[1]


# --- tables --------------------------------------------------------------------------------------


def with_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", least: int = REVISIT_BYTES) -> DataFrame:
    """(pid, url, text, digest, size, refers_to): refers_to is null for responses.

    Payloads are compared in a slim table, so copies of one page are rows of some bytes there; only then do pages
    meet their decision, by id.
    """
    pid, text = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(_NO_ID)), F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = pages.select(pid.alias("pid"), F.col(f"`{url_col}`").alias("url"), text.alias("text"))
    rows = rows.select("*", F.sha1("text").alias("digest"), F.octet_length("text").alias("size"))
    slim = rows.where(F.col("size") >= least).select("pid", "digest", "size")
    first = slim.groupBy("digest", "size").agg(F.max("pid").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = slim.join(first, ["digest", "size"]).where("pid <> refers_to").select("pid", "digest", "size", "refers_to").distinct()
    return rows.join(again, ["pid", "digest", "size"], "left")


def write_archives(rows: DataFrame, uri: str, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write the rows of :func:`with_revisits` as ``part-*.warc.gz``; a file is closed when it reaches FILE_BYTES.

    A task's files bear a name of the attempt; the driver moves those of the attempts that ended well into place, a row
    a file of FILE_BYTES, and deletes what others left.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, attempt = TaskContext.get().partitionId(), 0, uuid.uuid4().hex
        ident = lambda x: f"{_PAGE}{'' if x == _NO_ID else x}"

        def members() -> Iterator[bytes]:
            for b in batches:
                for r in b.to_pylist():
                    kind = "response" if r["refers_to"] is None else "revisit"
                    yield member(record(kind, ident(r["pid"]), r["url"], r["digest"], r["text"].encode(), r["size"], date, None if r["refers_to"] is None else ident(r["refers_to"])))

        source = members()
        first = next(source, None)
        made: tuple[list[str], list[str]] = ([], [])
        while first is not None:
            made[0].append(f"part-{part:06d}-{n:04d}.{attempt}.tmp")
            made[1].append(f"part-{part:06d}-{n:04d}.warc.gz")
            with created(f"{uri}/{made[0][-1]}") as f:
                size = 0
                while first is not None and size < FILE_BYTES:
                    f.write(first)
                    size += len(first)
                    first = next(source, None)
            n += 1
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in made], ["made", "name"])

    with C.batch_rows(rows.sparkSession):
        found = C.mapped(rows.select("pid", "url", "text", "digest", "size", "refers_to"), run, "made string, name string").collect()
    for r in found:
        moved(f"{uri}/{r['made']}", f"{uri}/{r['name']}")
    for name, _ in listed(uri, ".tmp"):
        deleted(name)


def read_archives(spark: SparkSession, uri: str, split_bytes: int = SPLIT_BYTES, payloads: bool = True) -> DataFrame:
    """(file, offset, record_id, record_type, target_uri, refers_to, payload_digest, payload_bytes, payload) of all records under a folder."""
    files = [f for f in listed(uri, ".warc.gz") if f[1]]
    names = ["record_id", "record_type", "target_uri", "refers_to", "payload_digest", "payload_bytes", "payload"]
    types = [pa.string()] * 5 + [pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(name: str, out: list[tuple[int, dict]]) -> pa.RecordBatch:
            cols = [pa.array([r[n] for _, r in out], t) for n, t in zip(names, types, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array([name] * len(out)), pa.array([at for at, _ in out], pa.int64()), *cols], ["file", "offset", *names])

        for b in batches:
            for name, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                out, size = [], 0
                for at, data in records(name, start, start + split_bytes):
                    r = parse(data)
                    if not payloads:
                        r["payload"] = None
                    out.append((at, r))
                    size += len(r["payload"] or b"") + 200
                    if size > 1 << 22:
                        yield rows(name, out)
                        out, size = [], 0
                if out:
                    yield rows(name, out)

    fields = "file string, offset long, record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary"
    # a range of bytes is a task's worth of work; many small files share one
    tasks = max(1, min(-(-sum(n for _, n in files) // split_bytes), 100_000))
    ranges = spark.createDataFrame(files, "name string, size long").select("name", F.explode(F.sequence(F.lit(0), F.col("size") - 1, F.lit(split_bytes))).alias("start"))
    return C.mapped(ranges.repartition(tasks, F.xxhash64("name", "start")), run, fields)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri = C.scratch(spark, "warc")
    write_archives(with_revisits(C.table(spark, sf_dir, "pages")), uri)
    found = read_archives(spark, uri, payloads=False)
    page = lambda c: F.nullif(F.substring(c, len(_PAGE) + 1, 20), F.lit("")).cast("long")
    return found.select(page(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", page(F.col("refers_to")).alias("refers_to"))


#: The same rows in SQL, over the table itself.
ORACLE = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html FROM pages
), q AS (
  SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS payload_digest FROM p
), r AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS top FROM q
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to
FROM r
"""
