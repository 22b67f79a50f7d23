"""Operator 12: WARC archives, written from and read back as a table of chunks.

A payload is never one value once it has left its source: it is rows (record, chunk number, up to 1 MiB of data), each
with the payload's length and SHA-1 as far as that chunk, so the last one has the digest of the whole and nothing has
to hold or hash a record at once. Three steps:

1. Which record is stored and which only refers: rows of (record, id, length, digest), no payloads. Of equal payloads of
   at least 1000 bytes the one with the greatest id is a response (nulls are least, then the greatest record id), the
   others are revisits; shorter payloads are all responses. Groups are reduced before they are shuffled.
2. Writing: what a record is becomes its row number -1, before its chunks; rows are dealt by record and sorted by number,
   and a task writes them through, one gzip member a record, with a new archive beyond a given size. Archives have names
   of their own; what counts is the table of archives that the job returns, so a lost or repeated task leaves a file that
   nothing names.
3. Reading: a task streams an archive through one inflater and gives the chunks of each record with its header fields on
   the last one. Any WARC of version 1 is read, compressed or not, one record a member or many.

Rows: a null payload is an empty one; null ids are left out of the header and read back as null, null and repeated ids
and repeated rows are records of their own; a null url leaves out the target. Control characters, spaces and what isn't
ASCII in a url are percent-encoded. Payloads may hold any bytes, also what looks like a header. Very long payloads are
chunks like others. Extra columns are not read. An empty table gives no archive. A damaged or cut archive gives what
precedes the damage, and then a row that says so in `problem`.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.session import shared_dir

from .common import discard, materialize, small_batches, table

CHUNK = 1 << 20
SHARED_FROM = 1000  # bytes of a payload that others may refer to
ARCHIVE = 1 << 28  # compressed bytes after which the next archive begins
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNKS = "archive string, offset long, record_id string, chunk int, last boolean, size long, digest string, data binary, fields map<string,string>, problem string"


def scanned(pages: DataFrame) -> DataFrame:
    """A scanned table's rows with `record`, an id that is the same whenever the table is read."""
    m = F.md5(F.concat_ws("#", F.col("_metadata.file_path"), F.col("_metadata.row_index").cast("string")))
    return pages.withColumn("record", F.concat_ws("-", *[F.substring(m, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]))


def decide(pages: DataFrame, key: str = "page_id", payload: str = "html", least: int = SHARED_FROM) -> DataFrame:
    """(record, key, size, digest, refers, refers_to): refers is the record, refers_to the key that a revisit is equal to."""
    text = F.coalesce(F.col(payload), F.lit(""))
    seen = materialize(pages.select("record", F.col(key).alias("key"), F.octet_length(text).cast("long").alias("size"), F.sha1(text).alias("digest")), "digests")
    long = seen.where(F.col("size") >= least)
    best = long.groupBy("digest", "size").agg(F.max(F.struct("key", "record")).alias("best"))
    other = F.col("best.record") != F.col("record")
    told = long.join(best, ["digest", "size"]).select("record", "key", "size", "digest", F.when(other, F.col("best.record")).alias("refers"), F.when(other, F.col("best.key")).alias("refers_to"))
    out = told.unionByName(seen.where(F.col("size") < least).select("*", F.lit(None).cast("string").alias("refers"), F.lit(None).cast(pages.schema[key].dataType).alias("refers_to")))
    out._lodestone_path = seen._lodestone_path  # so that discard() takes the table behind it
    return out


def payload_chunks(pages: DataFrame, url: str = "url", payload: str = "html", chunk: int = CHUNK) -> DataFrame:
    """(record, chunk, last, url, data): payloads in pieces of at most `chunk` bytes, an empty one in one of none."""
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[list] = [[], [], [], [], []]
            data = batch.column(2).cast(pa.large_binary())
            for i in range(batch.num_rows):
                whole = memoryview(data[i].as_buffer() or b"")
                for k, at in enumerate(range(0, max(1, len(whole)), chunk)):
                    for column, value in zip(found, (i, k, at + chunk >= len(whole), k == 0, whole[at : at + chunk]), strict=True):
                        column.append(value)
            rows = pa.array(found[0], pa.int64())
            urls = pa.array([u if first else None for u, first in zip(batch.column(1).take(rows).to_pylist(), found[3], strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), pa.array(found[1], pa.int32()), pa.array(found[2]), urls, pa.array([bytes(d) for d in found[4]], pa.binary())], names=["record", "chunk", "last", "url", "data"])

    text = F.col(payload).cast("binary").alias("data")
    return pages.select("record", F.col(url).alias("url"), text).mapInArrow(run, "record string, chunk int, last boolean, url string, data binary")


def _uri(url: str) -> str:
    return "".join(chr(b) if 0x21 <= b <= 0x7E else f"%{b:02X}" for b in url.encode("utf-8", "replace"))


def _head(first: str, fields: dict[str, str | None]) -> bytes:
    return "".join([f"{first}\r\n", *[f"{k}: {v}\r\n" for k, v in fields.items() if v is not None], "\r\n"]).encode()


def _told(digest: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()


class _Archive:
    """One archive while it is written: gzip members, a record each."""

    def __init__(self, folder: str, date: str) -> None:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        name = f"{uuid.uuid4().hex}.warc.gz"
        self.path, self.date, self.size, self.records = f"{folder}/{name}", date, 0, 0
        self.out = system.open_output_stream(f"{root}/{name}", compression=None)
        about = b"software: a Spark writer of WARC archives\r\nformat: WARC File Format 1.1\r\n"
        self.begin("warcinfo", str(uuid.uuid5(uuid.NAMESPACE_URL, self.path)), len(about), {"WARC-Filename": name, "Content-Type": "application/warc-fields"})
        self.add(about)
        self.end()
        self.records = 0

    def begin(self, kind: str, record: str, length: int, fields: dict[str, str | None]) -> None:
        self.deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
        self.add(_head("WARC/1.1", {"WARC-Type": kind, "WARC-Record-ID": f"<urn:uuid:{record}>", "WARC-Date": self.date, **fields, "Content-Length": str(length)}))

    def add(self, data: bytes) -> None:
        self._write(self.deflate.compress(data))

    def end(self) -> None:
        self._write(self.deflate.compress(b"\r\n\r\n") + self.deflate.flush())
        self.records += 1

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)


def write_archives(decided: DataFrame, chunks: DataFrame, folder: str, archive: int = ARCHIVE, date: str = DATE, content: str = "text/html; charset=utf-8") -> DataFrame:
    """(path, records, bytes) of the archives written to a folder that all executors share, as a written table."""
    small_batches(decided.sparkSession)
    heads = decided.select("record", F.lit(-1).alias("chunk"), F.struct(F.col("key").cast("string").alias("key"), "size", "digest", "refers", F.col("refers_to").cast("string").alias("refers_to")).alias("head"))
    rows = heads.unionByName(chunks, allowMissingColumns=True).repartition("record").sortWithinPartitions("record", "chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, head, size, digest = None, None, 0, hashlib.sha1()

        def close() -> pa.RecordBatch:
            out.out.close()
            return pa.RecordBatch.from_arrays([pa.array([out.path]), pa.array([out.records], pa.int64()), pa.array([out.size], pa.int64())], names=["path", "records", "bytes"])

        for batch in batches:
            for record, chunk, told, last, url, data in zip(*(batch.column(c).to_pylist() for c in ("record", "chunk", "head", "last", "url", "data")), strict=True):
                if chunk < 0:
                    head = told
                    continue
                if chunk == 0:
                    out = out or _Archive(folder, date)
                    size, digest = 0, hashlib.sha1()
                    block = _head("HTTP/1.1 200 OK", {"Content-Type": content, "Content-Length": str(head["size"])})
                    common = {"WARC-Target-URI": None if url is None else _uri(url), "WARC-Payload-Digest": _told(head["digest"]), "Page-ID": head["key"], "Content-Type": "application/http; msgtype=response"}
                    if head["refers"] is None:
                        out.begin("response", record, len(block) + head["size"], common)
                    else:
                        out.begin("revisit", record, len(block), {**common, "WARC-Profile": PROFILE, "WARC-Refers-To": f"<urn:uuid:{head['refers']}>", "Refers-To-Page-ID": head["refers_to"]})
                    out.add(block)
                size += len(data)
                digest.update(data)
                if head["refers"] is None:
                    out.add(data)
                if last:
                    if (size, digest.hexdigest()) != (head["size"], head["digest"]):
                        raise ValueError(f"record {record} isn't the one that was read before")
                    out.end()
                    if out.size >= archive:
                        yield close()
                        out = None
        if out:
            yield close()

    return materialize(rows.mapInArrow(run, "path string, records long, bytes long"), "archives")


class _Source:
    """The bytes of an archive, inflated as they are asked for; `start` is where the member at hand begins."""

    def __init__(self, stream) -> None:
        self.stream, self.raw, self.read, self.start, self.held = stream, b"", 0, 0, bytearray()
        self._more()
        self.inflate = zlib.decompressobj(31) if self.raw[:2] == b"\x1f\x8b" else None

    def _more(self) -> bool:
        got = self.stream.read(1 << 16)
        self.read += len(got)
        self.raw += got
        return bool(got)

    def fill(self) -> bool:
        """At most 64 KiB more into `held`; whether there was any."""
        while self.raw or self._more():
            if self.inflate is None:
                self.held += self.raw
                self.raw = b""
                return True
            if self.inflate.eof:
                self.start, self.inflate = self.read - len(self.raw), zlib.decompressobj(31)
            data = self.inflate.decompress(self.raw, 1 << 16)
            self.raw = self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail
            if data:
                self.held += data
                return True
        if self.inflate is not None and not self.inflate.eof:
            raise ValueError("the archive ends inside a member")
        return False

    def line(self, most: int | None = None) -> bytes | None:
        """The next line, with its end; None at the end of the archive. most: bytes that it may have."""
        at = 0
        while (end := self.held.find(b"\n", at)) < 0:
            at = len(self.held)
            if most is not None and at >= most:
                break
            if not self.fill():
                if not self.held:
                    return None
                end = len(self.held) - 1
                break
        size = len(self.held) if end < 0 else end + 1
        return self.take(size if most is None else min(size, most))

    def take(self, most: int) -> bytes:
        if not self.held:
            self.fill()
        out = bytes(memoryview(self.held)[:most])
        del self.held[:most]
        return out


def _fields(lines: Callable[[], bytes | None]) -> dict[str, str]:
    """Header fields up to an empty line, names in lower case; the first of a name counts, folded lines are joined."""
    fields: dict[str, str] = {}
    name, first = None, False
    while (line := lines()) is not None and line.strip(b"\r\n"):
        text = line.decode("utf-8", "replace")
        if text[0] in " \t" and name:
            if first:
                fields[name] += " " + text.strip()
            continue
        name, _, value = text.partition(":")
        name = name.strip().lower()
        first = name not in fields
        fields.setdefault(name, value.strip())
    return fields


def _records(source: _Source, chunk: int) -> Iterator[tuple]:
    """(offset, record id, chunk, last, size, digest, data, fields, problem)."""
    while True:
        while (line := source.line()) is not None and not line.strip(b"\r\n"):
            pass
        if line is None:
            return
        offset = source.start
        if not line.startswith(b"WARC/"):
            raise ValueError("no record begins where one should")
        fields = _fields(source.line)
        if not fields.get("content-length", "").isdecimal():
            raise ValueError("a record has no length")
        left = int(fields["content-length"])
        if fields.get("content-type", "").startswith("application/http"):

            def line() -> bytes | None:
                nonlocal left
                got = source.line(left) if left else None
                left -= len(got or b"")
                return got

            status = line()
            fields.update({f"http:{k}": v for k, v in _fields(line).items()} | {"http": (status or b"").decode("utf-8", "replace").strip()})
        name, size, digest = fields.get("warc-record-id"), 0, hashlib.sha1()
        for k in itertools.count():
            data = bytearray()
            while len(data) < min(chunk, left):
                got = source.take(min(chunk, left) - len(data))
                if not got:
                    raise ValueError("the archive ends inside a record")
                data += got
            left -= len(data)
            size += len(data)
            digest.update(data)
            yield offset, name, k, not left, size, digest.copy().hexdigest(), bytes(data), None if left else fields, None
            if not left:
                break


def read_chunks(paths: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The chunks of all records of the archives in `path` (URIs); see CHUNKS. Field names are in lower case.

    Fields of an HTTP header in the block are there as `http:name`, and the payload is what follows that header.
    """
    kinds = [pa.string(), pa.int64(), pa.string(), pa.int32(), pa.bool_(), pa.int64(), pa.string(), pa.binary(), pa.map_(pa.string(), pa.string()), pa.string()]
    names = [c.split()[0] for c in CHUNKS.split(", ")]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([list(v.items()) if isinstance(v, dict) else v for v in c], k) for c, k in zip(zip(*rows), kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, held = [], 0
                system, place = fs.FileSystem.from_uri(path)
                with system.open_input_stream(place, compression=None) as stream:
                    try:
                        for row in _records(_Source(stream), chunk):
                            rows.append((path, *row))
                            held += len(row[6])
                            if held >= 4 << 20 or len(rows) >= 1024:
                                yield batch_of(rows)
                                rows, held = [], 0
                    except (ValueError, zlib.error) as e:
                        rows.append((path, *[None] * 8, str(e)))
                if rows:
                    yield batch_of(rows)

    n = paths.count()
    return paths.select("path").coalesce(1).repartition(max(n, 1)).mapInArrow(run, CHUNKS)  # an archive a task


def records_of(chunks: DataFrame, key: str = "page_id", kind: str = "long") -> DataFrame:
    """(key, payload_bytes, payload_digest, record_type, refers_to, stated_digest) of responses and revisits in read_chunks().

    A revisit's length and digest are those that its headers state for the whole payload. Damage fails the job.
    """

    def f(name: str) -> F.Column:
        return F.col("fields")[name]

    whole = chunks.where("last OR problem IS NOT NULL").withColumn("fields", F.when(F.col("problem").isNotNull(), F.raise_error(F.concat_ws(": ", "archive", "problem"))).otherwise(F.col("fields")))
    response = f("warc-type") == "response"
    return whole.where(f("warc-type").isin("response", "revisit")).select(
        f("page-id").cast(kind).alias(key),
        F.when(response, F.col("size")).otherwise(f("http:content-length").cast("long")).alias("payload_bytes"),
        F.when(response, F.col("digest")).otherwise(hex_digest(f("warc-payload-digest"))).alias("payload_digest"),
        f("warc-type").alias("record_type"), f("refers-to-page-id").cast(kind).alias("refers_to"), hex_digest(f("warc-payload-digest")).alias("stated_digest"),
    )


def hex_digest(told: F.Column) -> F.Column:
    """`sha1:` and 32 characters of base 32, or 40 of hex, as lower-case hex; JVM-side, five bytes at a time."""
    text = F.regexp_replace(told, "^(?i)sha1:", "")
    letters = F.translate(F.upper(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789ABCDEFGHIJKLMNOPQRSTUV")
    blocks = [F.lpad(F.conv(F.substring(letters, 1 + 8 * i, 8), 32, 16), 10, "0") for i in range(4)]
    return F.lower(F.when(F.length(text) == 32, F.concat(*blocks)).otherwise(text))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = scanned(table(spark, sf_dir, "pages")).select("record", "page_id", "url", "html")
    folder = f"{shared_dir(spark)}/lodestone/{uuid.uuid4().hex}/warc"
    decided = decide(pages)
    archives = write_archives(decided, payload_chunks(pages), folder)
    discard(decided)
    return records_of(read_chunks(archives)).drop("stated_digest")


OP12_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
q AS (SELECT page_id, strlen(t) AS n, sha1(t) AS d, row_number() OVER (PARTITION BY t ORDER BY page_id DESC NULLS LAST) AS r, max(page_id) OVER (PARTITION BY t) AS top FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
  CASE WHEN n >= 1000 AND r > 1 THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND r > 1 THEN top END AS refers_to
FROM q"""
