"""WARC archives: a writer with one gzip member a record, and a reader that salvages damaged ones.

Records whose payloads are equal are kept once: the one of the largest id is a response, the
others revisit it. Each attempt at a writing task fills a folder of its own and names it in its row;
the rows of the attempts that counted are the manifest by which archives are read, so what a lost
attempt left is passed over. Files are closed at a size, so a reader never
holds more than that and one record. The reader checks every member and record; after a failure
it searches for the next valid member or version line and notes the bytes in between as a gap.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut, shared_dir, table

FILE_BYTES = 32 << 20
VERSION = b"WARC/1.1\r\n"
VERSION_LINE = re.compile(rb"WARC/1\.[01]\r\n")
MEMBER = b"\x1f\x8b\x08"
LEVEL, PIECE = 1, 1 << 15


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, uri: str, key: int | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record; a revisit holds the HTTP header only, whose Content-Length is the payload's."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if kind == "response" else b"")
    name = lambda k: f"<urn:page:{'' if k is None else k}>"
    fields = [
        ("WARC-Type", kind), ("WARC-Record-ID", name(key)), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", uri)),
        ("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{digest_of(block)}"), ("Content-Type", "application/http; msgtype=response"),
    ]
    if kind == "revisit":
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", name(refers_to))]
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return VERSION + head.encode("utf-8", "replace") + b"\r\n" + block + b"\r\n\r\n"


def member(raw: bytes) -> bytes:
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


class Record(NamedTuple):
    offset: int
    kind: str
    fields: dict[str, str]
    block: bytes

    def payload(self) -> bytes:
        return self.block.partition(b"\r\n\r\n")[2]

    def http_length(self) -> int | None:
        found = re.search(rb"(?im)^content-length:[ \t]*(\d+)", self.block.partition(b"\r\n\r\n")[0])
        return int(found[1]) if found else None


class Gap(NamedTuple):
    start: int
    end: int
    reason: str


def parse_record(raw: bytes, at: int, offset: int) -> tuple[Record, int] | str:
    """The record at ``at`` and where it ends, or what is wrong with it."""
    if not VERSION_LINE.match(raw, at):
        return "no version line"
    end = raw.find(b"\r\n\r\n", at)
    if end < 0:
        return "header cut off"
    fields = {}
    for line in raw[at:end].split(b"\r\n")[1:]:
        k, colon, v = line.partition(b":")
        if not colon:
            return "bad header line"
        fields[k.decode("utf-8", "replace").strip().lower()] = v.decode("utf-8", "replace").strip()
    size = fields.get("content-length", "")
    if not size.isascii() or not size.isdigit():
        return "bad content length"
    begin = end + 4
    stop = begin + int(size)
    if raw[stop : stop + 4] != b"\r\n\r\n":
        return "content length does not end the record"
    block = raw[begin:stop]
    digest = fields.get("warc-block-digest", "")
    if digest.startswith("sha1:") and digest[5:] != digest_of(block):
        return "block digest differs"
    return Record(offset, fields.get("warc-type", ""), fields, block), stop + 4


def _scattered(raw: bytes, at: int) -> list[Record]:
    """The whole records at the version lines of a member's bytes, as far as it could be read."""
    out, inner = [], 0
    while found := VERSION_LINE.search(raw, inner):
        got = parse_record(raw, found.start(), at)
        if isinstance(got, str):
            inner = found.start() + 1
        else:
            out.append(got[0])
            inner = got[1]
    return out


def _next_record(data: bytes, at: int) -> tuple[list[Record], int] | tuple[str, list[Record]]:
    """The records of the member, or the bare record, at ``at``, and where that ends; or what is wrong, and the records that a damaged member still has."""
    if data.startswith(MEMBER, at):
        z, parts, read = zlib.decompressobj(31), [], at
        try:
            while not z.eof and read < len(data):  # a piece at a time, as what follows a member is copied
                parts.append(z.decompress(data[read : read + PIECE]))
                read = min(len(data), read + PIECE)
        except zlib.error as e:
            return f"gzip: {str(e)[:60]}", _scattered(b"".join(parts), at)
        raw = b"".join(parts)
        if not z.eof:
            return "gzip member cut off", _scattered(raw, at)
        end, inner, out = read - len(z.unused_data), 0, []
        while inner < len(raw):
            got = parse_record(raw, inner, at)
            if isinstance(got, str):
                return got, _scattered(raw, at)
            out.append(got[0])
            inner = got[1]
        return (out, end) if out else ("empty member", [])
    got = parse_record(data, at, at)
    return (got, []) if isinstance(got, str) else ([got[0]], got[1])


def salvage(data: bytes) -> Iterator[Record | Gap]:
    """The records of one archive, compressed by member or not, in order, with a Gap for each span of bytes that yields none.

    A span begins where a check failed and ends at the next member or version line from which a
    whole record can be read, or with the archive. Of a damaged member that holds several records, the
    whole ones come before the gap.
    """
    at = 0
    while at < len(data):
        got = _next_record(data, at)
        if not isinstance(got[0], str):
            yield from got[0]
            at = got[1]
            continue
        start, reason = at, got[0]
        yield from got[1]
        while at < len(data):
            found = [x for x in (data.find(MEMBER, at + 1), *(m.start() for m in [VERSION_LINE.search(data, at + 1)] if m)) if x >= 0]
            at = min(found, default=len(data))
            if at == len(data) or not isinstance((got := _next_record(data, at))[0], str) or got[1]:
                break
        yield Gap(start, at, reason)


def _filesystem(root: str):
    """A file system for ``root`` and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)


def write_archives(rows: DataFrame, root: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes (key, uri, payload binary, digest, kind, refers_to) to ``root``; the manifest: (folder, files, records, bytes) of each task that had rows. Keep its rows (a checkpoint), as another run writes other folders."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        files, top = _filesystem(root)
        name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        task = f"{top}/{name}"
        number = records = size = 0
        out, held = None, 0
        for batch in batches:
            columns = [batch.column(k) for k in range(6)]
            for key, uri, payload, digest, kind, refers_to in zip(*columns):
                if out is None:
                    files.create_dir(task, recursive=True)
                    out, held = files.open_output_stream(f"{task}/{number:05d}.warc.gz", compression=None), 0
                    number += 1
                raw = member(record(kind.as_py(), uri.as_py() or "", key.as_py(), payload.as_py(), digest.as_py(), refers_to.as_py()))
                out.write(raw)
                records, size, held = records + 1, size + len(raw), held + len(raw)
                if held >= file_bytes:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        if not records:
            return
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (name, number, records, size)], ["folder", "files", "records", "bytes"])

    order = ["key", "uri", "payload", "digest", "kind", "refers_to"]
    return rows.select(*order).mapInArrow(run, "folder string, files long, records long, bytes long")


RECORDS = "path string, offset long, page_id long, uri string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary, gap_end long, reason string"


def read_archives(spark: SparkSession, paths: list[str] | str, payloads: bool = True) -> DataFrame:
    """RECORDS: a row for each record (gap_end and reason null), and one for each gap (record_type ``gap``, its bytes from offset to gap_end).

    ``payloads``: whether responses carry theirs. A file is held whole by one task, so archives
    should be closed at a few dozen MB, as the writer does.
    """
    ident = re.compile(r"<urn:page:(-?\d+)>")
    names = [c.split()[0] for c in RECORDS.split(", ")]
    kinds = [{"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[c.split()[1]] for c in RECORDS.split(", ")]

    def number(text: str) -> int | None:
        found = ident.fullmatch(text)
        return int(found[1]) if found else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                for x in salvage(data.as_py()):
                    if isinstance(x, Gap):
                        out.append((path, x.start, None, None, "gap", None, None, None, None, x.end, x.reason))
                    else:
                        own = x.payload() if payloads and x.kind == "response" else None
                        digest = x.fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
                        out.append((path, x.offset, number(x.fields.get("warc-record-id", "")), x.fields.get("warc-target-uri"), x.kind, x.http_length(), digest, number(x.fields.get("warc-refers-to", "")), own, None, None))
                        size += len(own or b"")
                    if len(out) >= 5000 or size > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
                        out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInArrow(run, RECORDS)


def revisits(pages: DataFrame, least: int = 0, key: str = "page_id", uri: str = "url", payload: str = "html") -> DataFrame:
    """What :func:`write_archives` takes: pages of equal payloads of ``least`` bytes or more are revisits but for the one of the largest key.

    Null payloads are empty. A null key is the smallest; rows that share the largest key are all
    responses. The groups' keys are summed before they are shuffled; payloads go to their group
    by a join that Spark splits where a group is large.
    """
    body = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    own = pages.select(F.col(key).cast("long").alias("key"), F.col(uri).alias("uri"), body.alias("payload"))
    own = own.withColumn("sha1", F.sha1("payload"))
    groups = own.where(F.length("payload") >= least).groupBy("sha1").agg(F.max("key").alias("last"), F.count("*").alias("n")).where("n > 1").select("sha1", "last")
    joined = own.join(groups, "sha1", "left")
    again = F.col("last").isNotNull() & (F.length("payload") >= least) & ~F.col("key").eqNullSafe(F.col("last"))
    return joined.select("key", "uri", "payload", base32(F.col("sha1")).alias("digest"), F.when(again, "revisit").otherwise("response").alias("kind"), F.when(again, F.col("last")).alias("refers_to"))


def base32(hexadecimal):
    """Upper-case base32 of a SHA-1 in hexadecimal: five hexadecimal digits are four letters."""
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    def letters(k: int):  # noqa: E306
        value = F.conv(F.substring(hexadecimal, 5 * k + 1, 5), 16, 10).cast("int")
        return [F.substring(F.lit(alphabet), (F.shiftright(value, 5 * (3 - j)).bitwiseAND(31) + 1), F.lit(1)) for j in range(4)]
    return F.concat(*[x for k in range(8) for x in letters(k)])  # noqa: E305


def archive(pages: DataFrame, root: str | None = None, least: int = 0) -> tuple[str, DataFrame]:
    """Writes ``pages`` (page_id, url, html) as WARC files; where they are, and a row for each task's folder."""
    root = root or f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    return root, cut(write_archives(revisits(pages, least), root))


def written(records: DataFrame, made: DataFrame) -> DataFrame:
    """Of RECORDS, those in folders of the manifest, which is broadcast: it has a row for each task that wrote."""
    folder = F.regexp_extract("path", "/(part-[^/]+)/[^/]+$", 1)
    return records.withColumn("_folder", folder).join(F.broadcast(made.select(F.col("folder").alias("_folder"))), "_folder", "left_semi").select(*records.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: every page, written to archives and read back."""
    root, made = archive(table(spark, sf_dir, "pages"))
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    if made.isEmpty():
        return spark.range(0).select(*[F.lit(None).cast("string" if c in ("payload_digest", "record_type") else "long").alias(c) for c in columns])
    found = written(read_archives(spark, f"{root}/part-*", payloads=False), made)
    # what was just written has no gaps; were there one, pages would be missing
    whole = F.when(F.col("record_type") == "gap", F.raise_error(F.concat(F.lit("a gap in "), "path"))).otherwise(F.lit(True))
    return found.where(whole).select(*columns)


ORACLE = """
WITH own AS (
  SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages
), coded AS (
  SELECT page_id, body, max(page_id) OVER (PARTITION BY body) AS last,
         array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           CAST((CAST(('0x' || substr(h, 5 * (i // 4) + 1, 5)) AS BIGINT) >> (5 * (3 - i % 4))) & 31 AS INTEGER) + 1, 1)), '') AS digest
  FROM own
) SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, digest AS payload_digest,
         CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to FROM coded
"""
