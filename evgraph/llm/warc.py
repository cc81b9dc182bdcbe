"""WARC archives with a two-level capture index.

Every page becomes one record, compressed as a gzip member of its own, in archives that
each task writes without moving the pages. The captures (key, page, archive, offset, length)
are then sorted by reversed-host URL key and cut into compressed blocks of BLOCK lines. Each index file
ends in its directory, one line a block: first and last key, place and length. A list of the index files (one row a
task that wrote one) has the keys that each begins and ends with.

Looking keys up is a binary search for the files and in their directories, which gives blocks; then one read of each
block, a binary search in it, and range reads of the archives. The query reads all records back in this way,
by distinct key; a key with many captures has many blocks, which are read by different tasks.

Payloads of at least MIN_PAYLOAD bytes that are equal (by SHA-1 and length) are stored once,
as the response of the largest page_id; the others are revisit records that refer to it.

Defined results: null html is an empty payload, a null url an empty key; rows with equal
page_id and payload are all responses; null page_ids are kept and never refer to anything but a
larger id. Only page_id, url and html are read: other columns may have any name. Archives and index files are renamed into place, so retried tasks leave whole files.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from bisect import bisect_left, bisect_right
from collections import OrderedDict
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, filesystem, put_file, scratch, small_batches

MIN_PAYLOAD = 1000
#: Captures in an index block; bytes of records that a task reads back, about; archives that it holds open.
BLOCK, READ_BYTES, OPEN = 256, 32 << 20, 16
#: Bytes after which an archive is closed and the next begun.
ARCHIVE_BYTES = 64 << 20
#: Revisits up to which their table is broadcast (24 bytes each); beyond, the join shuffles.
BROADCAST_ROWS = 200_000
DATE = "2000-01-01T00:00:00Z"


def url_key(url: str | None) -> str:
    """com,example,www)/path?query: hosts of one domain sort together."""
    try:
        parts = urlsplit((url or "").strip())
        host = parts.hostname or ""
        port = f":{parts.port}" if parts.port and parts.port not in (80, 443) else ""
    except ValueError:
        return re.sub(r"[\t\n]", "%20", (url or "").strip().lower())
    query = f"?{parts.query}" if parts.query else ""
    return ",".join(reversed(host.split("."))) + port + ")" + re.sub(r"[\t\n]", "%20", (parts.path or "/") + query)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record as a gzip member. A revisit keeps the HTTP head, whose length is the payload's."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = http if refers_to is not None else http + payload
    fields = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        "WARC-Target-URI: " + re.sub(r"[\r\n]+", "%0A", url or ""),
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    if refers_to is not None:
        fields += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    squeeze = zlib.compressobj(4, zlib.DEFLATED, 31)
    return squeeze.compress("\r\n".join(fields).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + squeeze.flush()


def parse_record(member: bytes) -> dict:
    """The fields of a record and, for a response, its payload."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    fields["payload_bytes"] = int(re.search(rb"Content-Length: (\d+)", http)[1])
    fields["payload"] = payload if fields["WARC-Type"] == "response" else None
    return fields


def _number(urn: str) -> int | None:
    return int(x) if (x := urn[len("<urn:page:") : -1]) else None


def revisits(pages: DataFrame) -> DataFrame:
    """(page_id, sha, size, owner) of the rows that repeat a payload: only keys and digests are shuffled, after summing within tasks."""
    keyed = pages.select("page_id", F.sha1(F.col("html").cast("binary")).alias("sha"), F.octet_length("html").alias("size")).where(F.col("size") >= MIN_PAYLOAD)
    owners = keyed.groupBy("sha", "size").agg(F.max("page_id").alias("owner"), F.count("*").alias("n")).where("n > 1")
    return keyed.join(owners, ["sha", "size"]).where("page_id < owner").select("page_id", "sha", "owner").distinct()


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write a record per page; the captures: key, page_id, path, offset, length."""
    spark = pages.sparkSession
    whole = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    again = revisits(whole)
    again = again.hint("broadcast") if again.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else again
    rows = whole.withColumn("sha", F.sha1(F.col("html").cast("binary"))).join(again, ["page_id", "sha"], "left").select("page_id", "url", "html", "sha", "owner")
    fs, root = filesystem(folder)
    fs.create_dir(root, recursive=True)
    schema = pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("path", pa.string()), ("at", pa.int64()), ("size", pa.int64())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, place = filesystem(folder)
        part, made, size = TaskContext.get().partitionId(), 0, 0
        members: list[bytes] = []
        captures: list[tuple] = []

        def close() -> pa.RecordBatch:
            nonlocal made, size
            name = f"/part-{part:06d}-{made:05d}.warc.gz"
            put_file(own, place + name, iter(members))
            out = batch(schema, *map(list, zip(*((k, i, name, at, n) for k, i, at, n in captures), strict=True)))
            members.clear()
            captures.clear()
            made, size = made + 1, 0
            return out

        for b in batches:
            for page_id, url, html, sha, owner in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "sha", "owner")), strict=True):
                member = record(page_id, url, html.encode(), sha, owner)
                captures.append((url_key(url), page_id, size, len(member)))
                members.append(member)
                size += len(member)
                if size >= ARCHIVE_BYTES:
                    yield close()
        if members:
            yield close()

    small_batches(spark)
    captures = rows.mapInArrow(write, "key string, page_id long, path string, at long, size long")
    # The archives are written once: what follows reads the captures from the shared folder.
    listed = scratch(spark, "captures")
    captures.write.parquet(listed)
    return spark.read.schema(captures.schema).parquet(listed)


def write_index(captures: DataFrame, folder: str) -> DataFrame:
    """Sorted captures in compressed blocks; the index files: first_key, last_key, path, at and size (of the file's directory), n (its blocks)."""
    fs, root = filesystem(folder)
    fs.create_dir(root, recursive=True)
    schema = pa.schema([("first_key", pa.string()), ("last_key", pa.string()), ("path", pa.string()), ("at", pa.int64()), ("size", pa.int64()), ("n", pa.int64())])

    def pack(lines: list[tuple]) -> bytes:
        return gzip.compress("\n".join("\t".join(map(str, x)) for x in lines).encode(), 6, mtime=0)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, place = filesystem(folder)
        name = f"/index-{TaskContext.get().partitionId():06d}.gz"
        lines: list[tuple] = []
        blocks: list[bytes] = []
        found: list[tuple] = []
        end = 0

        def close(chunk: list[tuple]) -> None:
            nonlocal end
            blocks.append(pack(chunk))
            found.append((chunk[0][0], chunk[-1][0], end, len(blocks[-1])))
            end += len(blocks[-1])

        for b in batches:
            lines += zip(*(["" if v is None else v for v in b.column(c).to_pylist()] for c in ("key", "page_id", "path", "at", "size")), strict=True)
            full = len(lines) - len(lines) % BLOCK
            for k in range(0, full, BLOCK):
                close(lines[k : k + BLOCK])
            del lines[:full]
        if lines:
            close(lines)
        if blocks:
            blocks.append(pack(found))
            put_file(own, place + name, iter(blocks))
            yield batch(schema, [found[0][0]], [found[-1][1]], [name], [end], [len(blocks[-1])], [len(found)])

    ordered = captures.repartitionByRange("key", "page_id", "path", "at").sortWithinPartitions("key", "page_id", "path", "at")
    directory = ordered.mapInArrow(write, "first_key string, last_key string, path string, at long, size long, n long")
    listed = scratch(captures.sparkSession, "directory")
    directory.write.parquet(listed)
    return captures.sparkSession.read.schema(directory.schema).parquet(listed)


def unpack(fs, path: str, at: int, size: int) -> list[list[str]]:
    with fs.open_input_file(path) as f:
        return [line.split("\t") for line in gzip.decompress(bytes(f.read_at(size, at))).decode().split("\n")]


def holding(firsts: list[str], lasts: list[str], key: str) -> range:
    """Which of the neighbouring ranges, sorted by their first and last keys, may hold the key: two binary searches."""
    return range(bisect_left(lasts, key), bisect_right(firsts, key))


class Directories:
    """The index files, whose directories are read when a key leads there; one is held at a time, as keys come sorted."""

    def __init__(self, files: list[tuple], index: str):
        self.files = sorted(files, key=lambda f: f[2])  # they are numbered in key order
        self.firsts, self.lasts = [f[0] for f in self.files], [f[1] for f in self.files]
        self.fs, self.index = filesystem(index)
        self.held: tuple[int, list[str], list[str], list[list[str]]] = (-1, [], [], [])

    def find(self, key: str) -> Iterator[tuple[str, int, int]]:
        """(path, at, size) of the blocks that may hold captures of the key."""
        for k in holding(self.firsts, self.lasts, key):
            _, _, path, at, size, _ = self.files[k]
            if self.held[0] != k:
                lines = unpack(self.fs, self.index + path, at, size)
                self.held = (k, [x[0] for x in lines], [x[1] for x in lines], lines)
            for j in holding(self.held[1], self.held[2], key):
                yield path, int(self.held[3][j][2]), int(self.held[3][j][3])


def captures_in(lines: list[list[str]], key: str) -> list[list[str]]:
    """A key's captures (key, page_id, path, at, size) in a block's lines, by binary search."""
    return lines[bisect_left(lines, key, key=lambda x: x[0]) : bisect_right(lines, key, key=lambda x: x[0])]


def locate(directory: DataFrame, keys: DataFrame, index: str) -> DataFrame:
    """key, path, at, size: the index blocks that may hold captures of each distinct key.

    The list of index files is sent to all tasks: as many rows as tasks wrote the index. Keys are sorted, so a task
    reads the directories of its range of keys only.
    """
    sent = directory.sparkSession.sparkContext.broadcast([tuple(r) for r in directory.collect()])
    schema = pa.schema([("key", pa.string()), ("path", pa.string()), ("at", pa.int64()), ("size", pa.int64())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        directories = Directories(sent.value, index)
        for b in batches:
            for some in range(0, b.num_rows, BLOCK):
                found = [(key, *place) for key in b.column("key")[some : some + BLOCK].to_pylist() for place in directories.find(key)]
                if found:
                    yield batch(schema, *map(list, zip(*found, strict=True)))

    distinct = keys.select("key").distinct().repartitionByRange("key").sortWithinPartitions("key")
    return distinct.mapInArrow(search, "key string, path string, at long, size long")


def _searched(fs, index: str, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[list[str]]]]:
    """Of rows of locate(), sorted by block: each key with its captures there. A block is read once."""
    held, lines = None, []
    for b in batches:
        for key, path, at, size in zip(*(b.column(c).to_pylist() for c in ("key", "path", "at", "size")), strict=True):
            if held != (path, at):
                held, lines = (path, at), unpack(fs, index + path, at, size)
            yield key, captures_in(lines, key)


def read_through_index(directory: DataFrame, keys: DataFrame, index: str, archives: str, tasks: int) -> DataFrame:
    """Look each distinct key up and read its records back, a range of an archive each, in so many tasks."""
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index_fs, root = filesystem(index)
        archive_fs, place = filesystem(archives)
        opened: OrderedDict[str, pa.NativeFile] = OrderedDict()
        out: list[tuple] = []
        for _, found in _searched(index_fs, root, batches):
            for _, _, path, at, size in sorted(found, key=lambda c: (c[2], int(c[3]))):
                if path not in opened:
                    opened[path] = archive_fs.open_input_file(place + path)
                    if len(opened) > OPEN:
                        opened.popitem(last=False)[1].close()
                opened.move_to_end(path)
                r = parse_record(bytes(opened[path].read_at(int(size), int(at))))
                if r["payload"] is None:
                    digest = base64.b32decode(r["WARC-Payload-Digest"][5:]).hex()
                else:
                    digest = hashlib.sha1(r["payload"]).hexdigest()
                refers = _number(r["WARC-Refers-To"]) if "WARC-Refers-To" in r else None
                out.append((_number(r["WARC-Record-ID"]), r["payload_bytes"], digest, r["WARC-Type"], refers))
            if len(out) >= BLOCK:
                yield batch(schema, *map(list, zip(*out, strict=True)))
                out = []
        if out:
            yield batch(schema, *map(list, zip(*out, strict=True)))

    blocks = locate(directory, keys, index).repartition(tasks, "path", "at").sortWithinPartitions("path", "at")
    return blocks.mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def look_up(directory: DataFrame, urls: DataFrame, index: str) -> DataFrame:
    """(key, page_id) of the captures of the urls' distinct keys."""
    schema = pa.schema([("key", pa.string())])

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield batch(schema, [url_key(u) for u in b.column("url").to_pylist()])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(index)
        for key, found in _searched(fs, root, batches):
            ids = [int(c[1]) if c[1] else None for c in found]
            yield pa.RecordBatch.from_arrays([pa.array([key] * len(ids), pa.string()), pa.array(ids, pa.int64())], names=["key", "page_id"])

    blocks = locate(directory, urls.select(F.col("url").cast("string")).mapInArrow(keyed, "key string"), index)
    return blocks.sortWithinPartitions("path", "at").mapInArrow(search, "key string, page_id long")


def warc(pages: DataFrame) -> DataFrame:
    spark = pages.sparkSession
    archives, index = scratch(spark, "warc"), scratch(spark, "warc-index")
    captures = write_archives(pages, archives)
    tasks = max(spark.sparkContext.defaultParallelism, (captures.agg(F.sum("size")).first()[0] or 0) // READ_BYTES)
    return read_through_index(write_index(captures, index), captures, index, archives, tasks)


ORACLE_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS size, sha1(coalesce(html, '')) AS digest FROM pages),
o AS (SELECT digest, max(page_id) AS owner FROM p WHERE size >= 1000 GROUP BY digest)
SELECT page_id, size AS payload_bytes, digest AS payload_digest,
       CASE WHEN size >= 1000 AND page_id < owner THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN size >= 1000 AND page_id < owner THEN owner END AS refers_to
FROM p LEFT JOIN o USING (digest)
"""
