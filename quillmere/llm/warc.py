"""WARC archives: writing with revisits and segments, reading with reassembly.

Writing: one archive of gzip members for each partition, and a second one for continuation records.
A response is an HTTP message with chunked transfer framing; where its block is longer than SEGMENT
bytes the rest goes to continuation records. Files are written under another name and renamed, and
named by partition, so a task that runs again replaces its own files.

Reading: Spark reads the files; records of one segment are decoded where they are parsed. Of the
others only the segments are exchanged, by origin identifier and in order of segment number; their
total length is verified and the chunked framing decoded. Archives are decompressed in pieces of READ
bytes, so a task holds an archive's bytes as they lie and one record. A record that lacks a segment, or
whose length, framing or digest is wrong, comes out with valid false. Where an archive is damaged (a cut
or broken gzip member, a header that is none, a block shorter than it says) the records before it are
read, the damaged one comes out with valid false, and reading goes on at the next gzip member; in a plain
archive at the next line that begins a record.

Which page of equal payloads is the response is a max by digest, combined on the map side, joined
back by digest; AQE may split that join where one payload is very frequent.

Defined cases: null html is an empty payload. Rows with a null page_id are written and read back with
a null page_id; among equal payloads they revisit the largest page_id, if there is one. Repeated
rows give repeated records. url may be null. Other columns are not read. An empty table gives archives
without records, and these give no rows. Archives of one partition are read by one task. Writing needs a
folder that pyarrow's file systems reach (local, hdfs, s3, gs, abfs by their own URIs).
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import zlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import new_path, prepare, table

LEAST_REVISIT, SEGMENT, CHUNK, READ = 1000, 16_384, 8_192, 1 << 16
_ID = "<urn:quillmere:page:{}:{}>"
_DATE = "2024-01-01T00:00:00Z"
_GZIP, _EMPTY = b"\x1f\x8b\x08", gzip.compress(b"", mtime=0)
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"


def _record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [("WARC-Type", kind), ("WARC-Date", _DATE), *fields, ("Content-Length", str(len(block)))])
    return gzip.compress(b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n", 1, mtime=0)


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    parts = [b"%x\r\n%s\r\n" % (len(x), x) for x in (payload[k : k + size] for k in range(0, len(payload), size))]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; ValueError if its framing is wrong."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if not size:
            return b"".join(out)
        if len(body) < at + size + 2 or body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk without end")
        out.append(body[at : at + size])
        at += size + 2


def page_records(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, segment: int = SEGMENT) -> tuple[bytes, list[bytes]]:
    """The first record of a page and its continuation records."""
    name = "" if page_id is None else str(page_id)
    own = _ID.format(name, digest)
    labelled = "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()
    fields = [("WARC-Record-ID", own), ("WARC-Target-URI", (url or "").replace("\r", "").replace("\n", "")), ("WARC-Payload-Digest", labelled), ("Content-Type", "application/http; msgtype=response")]
    if revisit:
        fields += [("WARC-Refers-To", _ID.format(refers_to, digest)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
        return _record("revisit", fields, _HTTP + b"Content-Length: %d\r\n\r\n" % len(payload)), []
    block = _HTTP + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    if len(block) <= segment:
        return _record("response", fields, block), []
    parts = [block[k : k + segment] for k in range(0, len(block), segment)]
    rest = []
    for k, part in enumerate(parts[1:], 2):
        more = [("WARC-Record-ID", f"{own[:-1]}:{k}>"), ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", str(k))]
        rest.append(_record("continuation", more + [("WARC-Segment-Total-Length", str(len(block)))] * (k == len(parts)), part))
    return _record("response", [*fields, ("WARC-Segment-Number", "1")], parts[0]), rest


def _write(batches: Iterator[pa.RecordBatch], folder: str, segment: int) -> Iterator[pa.RecordBatch]:
    fs, root = pa.fs.FileSystem.from_uri(folder)
    task = TaskContext.get()
    fs.create_dir(root, recursive=True)
    names = [f"{root}/part-{task.partitionId():06d}{x}.warc.gz" for x in ("", "-more")]
    own = [f"{root}/.{task.taskAttemptId()}-{k}" for k in (0, 1)]
    n = 0
    with fs.open_output_stream(own[0], compression=None) as first, fs.open_output_stream(own[1], compression=None) as rest:
        for batch in batches:
            for r in batch.to_pylist():
                a, b = page_records(r["page_id"], r["url"], (r["html"] or "").encode(), r["digest"], r["keeper"], r["revisit"], segment)
                first.write(a)
                for x in b:
                    rest.write(x)
                n += 1 + len(b)
    for a, b in zip(own, names, strict=True):
        fs.move(a, b)
    yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["records"])


def write_archives(pages: DataFrame, folder: str, least: int = LEAST_REVISIT, segment: int = SEGMENT) -> int:
    """Writes pages (page_id, url, html) as archives into folder; gives the number of records."""
    prepare(pages.sparkSession)
    fs, root = pa.fs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    pages = pages.select("page_id", "url", "html", F.sha1(F.coalesce("html", F.lit(""))).alias("digest"), (F.octet_length(F.coalesce("html", F.lit(""))) >= least).alias("long"))
    keep = pages.where("long").groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).where("n > 1 and keeper is not null").select("digest", "keeper")
    told = pages.join(keep, "digest", "left")
    told = told.select("page_id", "url", "html", "digest", "keeper", (F.col("long") & F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))).alias("revisit"))
    return told.mapInArrow(partial(_write, folder=folder, segment=segment), "records long").agg(F.sum("records")).first()[0] or 0


def _number(text: str | None) -> int | None:
    text = (text or "").strip()
    return int(text) if text.isdecimal() else None


class _Bytes:
    """Bytes of an archive, decompressed in pieces as they are asked for; resume() goes to the next gzip member."""

    def __init__(self, raw: object) -> None:
        self.raw, self.at, self.held = memoryview(raw), 0, b""
        self.packed = bytes(self.raw[:2]) == _GZIP[:2]
        self.inflate = zlib.decompressobj(31) if self.packed else None

    def more(self) -> bool:
        """Adds a piece to what is held; False at the end, ValueError in a broken or cut member."""
        if not self.packed:
            piece = bytes(self.raw[self.at : self.at + READ])
            self.at += len(piece)
            self.held += piece
            return bool(piece)
        while self.at < len(self.raw):
            piece = self.raw[self.at : self.at + READ]
            self.at += len(piece)
            try:
                out = self.inflate.decompress(piece)
            except zlib.error as e:
                raise ValueError("broken gzip member") from e
            if self.inflate.eof:
                self.at -= len(self.inflate.unused_data)
                self.inflate = zlib.decompressobj(31)
            if out:
                self.held += out
                return True
        if self.packed and not _fresh(self.inflate):
            self.inflate = zlib.decompressobj(31)
            raise ValueError("cut gzip member")
        return False

    def line(self) -> bytes:
        """The next line with its end, shorter at the end of the archive."""
        while (k := self.held.find(b"\n")) < 0:
            if not self.more():
                k = len(self.held) - 1
                break
        out, self.held = self.held[: k + 1], self.held[k + 1 :]
        return out

    def take(self, n: int) -> bytes:
        parts, size = [self.held], len(self.held)
        while size < n:
            self.held = b""
            if not self.more():
                break
            parts.append(self.held)
            size += len(self.held)
        whole = b"".join(parts)
        self.held = whole[n:]
        return whole[:n]

    def resume(self, since: int, rest: bytes) -> None:
        """After damage: to the next member after byte since, or the next line from rest on that begins a record."""
        if self.packed:
            found = bytes(self.raw[since + 1 :]).find(_GZIP)
            self.at, self.held = (since + 1 + found if found >= 0 else len(self.raw)), b""
            self.inflate = zlib.decompressobj(31)
            return
        self.held = b"\n" + rest + self.held
        while True:
            found = self.held.find(b"\nWARC/")
            if found >= 0:
                self.held = self.held[found + 1 :]
                return
            self.held = self.held[-5:]
            if not self.more():
                self.held = b""
                return


def _fresh(inflate: object) -> bool:
    """Whether a decompressor has seen nothing of a member yet."""
    copy = inflate.copy()
    try:
        copy.decompress(_EMPTY)
    except zlib.error:
        return False
    return copy.eof


def records(raw: object) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of each record of an archive's bytes; field names in lower case. A damaged record
    has what fields were read, "damage" among them, and an empty block."""
    stream = _Bytes(raw)
    while True:
        begun, fields, rest = stream.at, {}, b""
        try:
            line = stream.line()
            if not line:
                return
            if not line.strip():
                continue
            if not line.startswith(b"WARC/"):
                raise ValueError("not a WARC record")
            while (line := stream.line()).strip():
                k, _, v = line.decode(errors="replace").partition(":")
                fields[k.strip().lower()] = v.strip()
            size = _number(fields.get("content-length"))
            if size is None:
                raise ValueError("no length")
            rest = block = stream.take(size)
            end = stream.take(4)
            rest += end
            if len(block) < size or end != b"\r\n\r\n":
                raise ValueError("no end of record after its length")
            yield fields, block
        except ValueError as e:
            yield fields | {"damage": str(e)}, b""
            stream.resume(begun, rest)


def _digest(fields: dict) -> str | None:
    """The payload digest in hex; None if there is none of a kind that is known."""
    kind, _, value = fields.get("warc-payload-digest", "").partition(":")
    try:
        return base64.b32decode(value).hex() if kind == "sha1" else None
    except ValueError:
        return None


def _page(name: str | None) -> int | None:
    """The page_id in a record's name; None for names that are not ours."""
    part = (name or "").strip("<>").split(":")
    own = part[:3] == _ID.strip("<>").split(":")[:3] and len(part) > 3 and part[3].lstrip("-").isdecimal()
    return int(part[3]) if own else None


def decoded(block: bytes) -> bytes:
    head, gap, body = block.partition(b"\r\n\r\n")
    if not gap:
        raise ValueError("HTTP headers without end")
    return unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body


_READ = "record_id string, page_id long, record_type string, payload_bytes long, payload_digest string, refers_to long, valid boolean, payload binary, origin string, segment int, total long, block binary"
_TYPES = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(), "int": pa.int32()}


def _batch(rows: list[tuple], schema: str = _READ) -> pa.RecordBatch:
    fields = [x.split() for x in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(list(c), _TYPES[t]) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def _whole(record_id: str, told: str | None, block: bytes, good: bool, payload: bool) -> tuple:
    try:
        body = decoded(block)
    except ValueError:
        return (record_id, _page(record_id), "response", None, told, None, False, None)
    digest = hashlib.sha1(body).hexdigest()
    return (record_id, _page(record_id), "response", len(body), digest, None, good and told in (None, digest), body if payload else None)


def _parse(batches: Iterator[pa.RecordBatch], payload: bool) -> Iterator[pa.RecordBatch]:
    """Whole records decoded; segments as they are, with origin and number."""
    for batch in batches:
        for content in batch.column("content"):
            rows, size = [], 0
            for fields, block in records(content.as_buffer()):
                kind, own = fields.get("warc-type"), fields.get("warc-record-id")
                number, total = fields.get("warc-segment-number"), fields.get("warc-segment-total-length")
                if "damage" in fields:
                    rows.append((own, _page(own), kind, None, _digest(fields), None, False, None, None, None, None, None))
                elif kind == "continuation" or number == "1":
                    told = _digest(fields)
                    rows.append((own, None, kind, None, told, None, None, None, fields.get("warc-segment-origin-id", own), _number(number), _number(total), block))
                    size += len(block)
                elif kind == "response":
                    rows.append((*_whole(own, _digest(fields), block, True, payload), None, None, None, None))
                    size += len(block) if payload else 0
                elif kind == "revisit":
                    length = next((_number(x[15:].decode(errors="replace")) for x in block.split(b"\r\n") if x.lower().startswith(b"content-length:")), None)
                    rows.append((own, _page(own), "revisit", length, _digest(fields), _page(fields.get("warc-refers-to")), length is not None, None, None, None, None, None))
                if len(rows) >= 2000 or size > 4 << 20:
                    yield _batch(rows)
                    rows, size = [], 0
            yield _batch(rows)


_DONE = ", ".join(_READ.split(", ")[:8])


def _joined(batches: Iterator[pa.RecordBatch], payload: bool) -> Iterator[pa.RecordBatch]:
    """Records from their segments; segments come sorted by origin and number, whole records pass."""

    def finished(rows: list[dict]) -> list[tuple]:
        first = [r for r in rows if r["segment"] == 1]
        parts = {r["segment"]: r["block"] for r in rows if r["segment"] is not None}
        total = next((r["total"] for r in rows if r["total"] is not None), None)
        block = b"".join(parts[k] for k in sorted(parts))
        good = [*sorted(parts)] == [*range(1, len(parts) + 1)] and total == len(block) and all(r["segment"] is not None for r in rows)
        origin = rows[0]["origin"]
        return [_whole(origin, r["payload_digest"], block, good, payload) for r in first] or [(origin, _page(origin), "response", None, None, None, False, None)]

    rows: list[dict] = []
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            if r["origin"] is None:
                out.append(tuple(r[x.split()[0]] for x in _DONE.split(", ")))
                continue
            if rows and rows[0]["origin"] != r["origin"]:
                out += finished(rows)
                rows = []
            rows.append(r)
        if out:
            yield _batch(out, _DONE)
    if rows:
        yield _batch(finished(rows), _DONE)


def read_archives(spark: SparkSession, folder: str, payload: bool = True) -> DataFrame:
    """The records of the archives *.warc and *.warc.gz in folder, one row for each response or
    revisit: record_id, page_id, record_type, payload_bytes, payload_digest, refers_to, valid, payload."""
    prepare(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").load(folder).select("content")
    parsed = files.mapInArrow(partial(_parse, payload=payload), _READ)
    # One parse and one exchange: what needs no reassembly passes through beside the segments.
    dealt = parsed.withColumn("key", F.coalesce("origin", "record_id")).repartition("key").sortWithinPartitions("key", "segment")
    return dealt.drop("key").mapInArrow(partial(_joined, payload=payload), _DONE)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), folder)
    read = read_archives(spark, folder, payload=False)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "valid")


OP8_SQL = r"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages),
k AS (SELECT d, max(page_id) AS m FROM p WHERE n >= 1000 GROUP BY d)
SELECT page_id, n AS payload_bytes, p.d AS payload_digest, CASE WHEN m IS NULL OR m = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN m <> page_id THEN m END AS refers_to, TRUE AS valid
FROM p LEFT JOIN k USING (d)
"""
