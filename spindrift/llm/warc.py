"""WARC archives written from and read back into tables of record chunks.

A payload is never held whole outside the row that it comes in: it is a *chunk table*, rows of a record and a chunk number with at most
``CHUNK`` bytes each. Writing cuts payloads into such rows in the JVM, in whose order a task streams them into gzip members, one for
each record; a task rolls its archive at ``ARCHIVE`` compressed bytes. Reading inflates an archive piece by piece and yields chunk
rows, each with the SHA-1 of the payload up to its end: the digest is carried from chunk to chunk, so the last chunk's is the
payload's, and no later step has to bring the chunks of a record together.

Records with equal payloads of ``LEAST`` bytes at least: the one with the largest ``page_id`` is a *response*, the others are
*revisits* that refer to it and have no payload. Payloads are told apart by SHA-256, as SHA-1 has known collisions. How many rows a payload has is an
aggregate that combines in the map tasks; the join of rows to the shared payloads has one row for a payload on one side, so that
Spark splits a hot payload's rows over tasks.

Archives are named by the attempt that wrote them, and the manifest, a table that Spark commits, names those of the attempts that
succeeded; what a lost executor left behind is in no manifest.

Defined results: a null payload counts as empty; a null address is left out of the record; control characters, spaces and
characters beyond ASCII in an address are percent-encoded, so that it can't end the header line. Rows without ``page_id`` rank last among
equal payloads. Rows that repeat page_id and payload of a response are responses too (a revisit of itself would say nothing), with
the same record id. An empty table gives no archive and an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import zlib
from base64 import b32decode, b32encode
from collections.abc import Iterator
from datetime import UTC, datetime
from hashlib import md5, sha1
from urllib.parse import quote
from uuid import UUID, uuid4

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow, scratch_path, table, written

LEAST, CHUNK, ARCHIVE, PIECE = 1000, 1 << 18, 1 << 28, 1 << 16
LEVEL = 4
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CHUNKS = "archive string, record long, record_type string, record_id string, refers_id string, page_id long, uri string, declared string, chunk long, start long, length long, data binary, sha1 string, last boolean"


def records(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, url, payload, bytes, digest, content (the payload's SHA-256), keep (the page that a revisit refers to, else null)."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url"), html.cast("binary").alias("payload"), F.octet_length(html).cast("long").alias("bytes"), F.sha1(html.cast("binary")).alias("digest"), F.sha2(html.cast("binary"), 256).alias("content")
    )
    shared = rows.where(F.col("bytes") >= least).groupBy(F.col("content").alias("of")).agg(F.max("page_id").alias("keep"), F.count(F.lit(1)).alias("n")).where("n > 1 AND keep IS NOT NULL").drop("n")
    joined = rows.join(written(shared, "warc-shared"), F.col("content") == F.col("of"), "left")
    return joined.withColumn("keep", F.when(~F.col("page_id").eqNullSafe(F.col("keep")), F.col("keep"))).drop("of")


def chunked(rows: DataFrame, size: int = CHUNK) -> DataFrame:
    """The chunk table of :func:`records`: a row for each ``size`` bytes of a payload, one at least, in order; a revisit has none of its payload."""
    bare = rows.withColumn("payload", F.when(F.col("keep").isNull(), F.col("payload")))
    last = F.when(F.col("keep").isNotNull() | (F.col("bytes") == 0), F.lit(0)).otherwise(F.floor((F.col("bytes") - 1) / size)).cast("long")
    out = bare.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    data = F.coalesce(F.substring("payload", F.col("chunk") * size + 1, F.lit(size)), F.lit(b""))
    return out.select("page_id", "url", "bytes", "digest", "content", "keep", "chunk", data.alias("data"))


def record_id(page_id: int | None, content: str) -> str:
    return f"<urn:uuid:{UUID(bytes=md5(f'{page_id}:{content}'.encode()).digest())}>"


def _head(row: dict, date: str) -> bytes:
    """The WARC header of a record, with the HTTP header that its block begins with."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['bytes']}\r\n\r\n"
    revisit = row["keep"] is not None
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(row['page_id'], row['content'])}", f"WARC-Date: {date}"]
    if row["url"] is not None:
        lines.append(f"WARC-Target-URI: {quote(row['url'], safe=':/?#[]@!$&()*+,;=%~' + chr(39))}")
    lines.append(f"WARC-Payload-Digest: sha1:{b32encode(bytes.fromhex(row['digest'])).decode()}")
    if revisit:
        lines += [f"WARC-Refers-To: {record_id(row['keep'], row['content'])}", f"WARC-Profile: {PROFILE}"]
    if row["page_id"] is not None:
        lines.append(f"Page-ID: {row['page_id']}")
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(http) + (0 if revisit else row['bytes'])}"]
    return ("\r\n".join(lines) + "\r\n\r\n" + http).encode()


class _Archives:
    """The archives that a task writes, one after the other."""

    def __init__(self, folder: str, most: int):
        self.store, self.folder = fs.FileSystem.from_uri(folder)
        self.most, self.name, self.out, self.records, self.done = most, "", None, 0, []
        self.store.create_dir(self.folder, recursive=True)

    def begin(self) -> None:
        """A new record: closes the one before, and the archive where it is full."""
        self.end()
        if self.out is not None and self.out.tell() >= self.most:
            self.close()
        if self.out is None:
            self.name = f"{uuid4().hex}.warc.gz"
            self.out, self.records = self.store.open_output_stream(f"{self.folder}/{self.name}", compression=None), 0
        self.member, self.records = zlib.compressobj(LEVEL, zlib.DEFLATED, 31), self.records + 1

    def write(self, data: bytes) -> None:
        self.out.write(self.member.compress(data))

    def end(self) -> None:
        if self.out is not None and self.member is not None:
            self.write(b"\r\n\r\n")
            self.out.write(self.member.flush())
            self.member = None

    def close(self) -> None:
        if self.out is not None:
            self.end()
            self.done.append((self.name, self.records, self.out.tell()))
            self.out.close()
            self.out = None


def write(chunks: DataFrame, folder: str | None = None, archive: int = ARCHIVE, date: str | None = None) -> DataFrame:
    """Write the records of a chunk table into archives; returns the manifest: archive (its path), records, bytes."""
    folder = folder or scratch_path(chunks.sparkSession, "warc")
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for batch in batches:
            heads = batch.drop_columns(["data"]).to_pylist()
            for row, data in zip(heads, batch.column("data"), strict=True):
                out = out or _Archives(folder, archive)
                if row["chunk"] == 0:
                    out.begin()
                    out.write(_head(row, date))
                out.write(data.as_buffer())
        if out is not None:
            out.close()
            names, counts, sizes = zip(*out.done, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{n}" for n in names], pa.string()), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64())], ["archive", "records", "bytes"])

    return written(arrow(chunks, stored, "archive string, records long, bytes long"), "warc-manifest")


class Inflated:
    """The bytes of an archive, inflated piece by piece; gzip members follow each other, a plain archive is taken as it is."""

    def __init__(self, file):
        self.file, self.held, self.raw = file, bytearray(), b""
        self.member: zlib._Decompress | None = None
        self.raw = file.read(PIECE)
        self.plain = not self.raw.startswith(b"\x1f\x8b")

    def _more(self) -> bool:
        """Inflate some more bytes into ``held``; False at the end of the archive."""
        if not self.raw:
            self.raw = self.file.read(PIECE)
            if not self.raw:
                if self.member is not None:
                    raise ValueError("the archive ends inside a gzip member")
                return False
        if self.plain:
            self.held += self.raw
            self.raw = b""
            return True
        self.member = self.member or zlib.decompressobj(31)
        self.held += self.member.decompress(self.raw, 4 * PIECE)
        if self.member.eof:
            self.raw, self.member = self.member.unused_data, None
        else:
            self.raw = self.member.unconsumed_tail
        return True

    def line(self) -> bytes | None:
        """The next line without its end; None at the end of the archive."""
        at = 0
        while (end := self.held.find(b"\r\n", at)) < 0:
            at = max(0, len(self.held) - 1)
            if not self._more():
                if self.held:
                    raise ValueError("the archive ends inside a header")
                return None
        out = bytes(self.held[:end])
        del self.held[: end + 2]
        return out

    def take(self, most: int) -> bytes:
        """``most`` bytes, fewer only at the end of the archive."""
        while len(self.held) < most and self._more():
            pass
        out = bytes(self.held[:most])
        del self.held[:most]
        return out


def _fields(source: Inflated) -> tuple[dict[str, str], int]:
    """The fields of a header and how many bytes it has."""
    out, size = {}, 0
    while line := source.line():
        name, _, value = line.decode("utf-8", "replace").partition(":")
        out[name.strip().lower()] = value.strip()
        size += len(line) + 2
    return out, size + 2


def _hex(declared: str | None) -> str | None:
    """A declared SHA-1, in base 32 or hexadecimal, as hexadecimal."""
    if not declared or not declared.lower().startswith("sha1:"):
        return None
    value = declared[5:]
    return b32decode(value).hex() if len(value) == 32 else value.lower()


def chunks_of(file, archive: str = "", size: int = CHUNK) -> Iterator[tuple]:
    """The chunk rows of an archive's records, as tuples; a record without payload has one row, without data."""
    source, number = Inflated(file), 0
    while (line := source.line()) is not None:
        if not line:  # records end with two empty lines
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"record {number} of {archive} has no beginning")
        head, _ = _fields(source)
        left = int(head["content-length"])
        if head.get("content-type", "").startswith("application/http") and left:
            status = source.line()
            left -= len(status) + 2 + _fields(source)[1]
        of = (archive, number, head.get("warc-type"), head.get("warc-record-id"), head.get("warc-refers-to"), int(head["page-id"]) if "page-id" in head else None, head.get("warc-target-uri"), _hex(head.get("warc-payload-digest")))
        digest, chunk, start = sha1(), 0, 0
        while True:
            data = source.take(min(size, left))
            if len(data) < min(size, left):
                raise ValueError(f"record {number} of {archive} ends early")
            left -= len(data)
            digest.update(data)
            yield (*of, chunk, start, len(data), data, digest.hexdigest(), left == 0)
            chunk, start = chunk + 1, start + len(data)
            if left == 0:
                break
        number += 1


def read(manifest: DataFrame, size: int = CHUNK) -> DataFrame:
    """The chunk table of the archives that a table names (``archive``): record, type, ids, declared digest, chunk, start, length, data, the SHA-1 so far, last."""
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in _CHUNKS.split(", "))])

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path in (x for b in batches for x in b.column("archive").to_pylist()):
            store, name = fs.FileSystem.from_uri(path)
            rows, held = [], 0
            with store.open_input_stream(name, compression=None) as file:
                for row in chunks_of(file, path, size):
                    rows.append(row)
                    held += len(row[-3]) + 256
                    if held > 4 << 20:
                        yield batch(rows)
                        rows, held = [], 0
            if rows:
                yield batch(rows)

    archives = manifest.select("archive")
    return arrow(archives.repartition(max(1, archives.count())), chunks, _CHUNKS)


def index(chunks: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, intact (the payload has the declared digest) of every record.

    Only the last chunk of each record is looked at. A revisit takes its size, and whether it is intact, from its response.
    """
    ends = written(chunks.where("last").drop("data", "archive", "record", "uri"), "warc-records").withColumn("bytes", F.col("start") + F.col("length"))
    whole = F.coalesce(F.col("sha1") == F.col("declared"), F.lit(True))
    responses = ends.where("record_type = 'response'")
    known = responses.groupBy(F.col("record_id").alias("of")).agg(F.max("page_id").alias("of_page"), F.max("bytes").alias("of_bytes"), F.min(whole).alias("of_whole"))
    revisits = ends.where("record_type = 'revisit'").join(written(known, "warc-responses"), F.col("refers_id") == F.col("of"), "left")
    return responses.select("page_id", F.col("bytes").alias("payload_bytes"), F.col("sha1").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"), whole.alias("intact")).unionByName(
        revisits.select("page_id", F.col("of_bytes").alias("payload_bytes"), F.col("declared").alias("payload_digest"), "record_type", F.col("of_page").alias("refers_to"), F.coalesce("of_whole", F.lit(False)).alias("intact"))
    )


def op12_warc_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index(read(write(chunked(records(table(spark, sf_dir, "pages"))))))


OP12_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
shared AS (SELECT html, max(page_id) AS keep FROM p WHERE strlen(html) >= {LEAST} GROUP BY html)
SELECT page_id, CAST(strlen(p.html) AS BIGINT) AS payload_bytes, sha1(p.html) AS payload_digest, CASE WHEN keep <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN keep <> page_id THEN keep END AS refers_to, true AS intact
FROM p LEFT JOIN shared USING (html)
"""
