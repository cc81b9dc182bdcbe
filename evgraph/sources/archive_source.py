"""Archives as a Spark data source: one large archive is read by many tasks.

An archive's central directory says where each entry lies, so a task opens the archive, seeks to the entries of its own range and unpacks
these alone. Ranges have about `range_bytes` unpacked bytes. Filters on path skip entries before they are unpacked, and with content=false nothing is
unpacked at all. Planning walks the directory of every archive on the driver, some bytes at a time, and keeps a row a range; a range names its own
part of the directory, so a task parses no other. For a few archives of any size. Very many small ones are read by files.read_archives, an archive a row.
Limits on entries and bytes are those of uploads unless others are named.
"""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringContains, StringEndsWith, StringStartsWith

from .files import MOST_ARCHIVE_BYTES, MOST_ENTRIES, MOST_ENTRY_BYTES, entry_problem

SCHEMA = "archive string, path string, size long, content binary, problem string"
RANGE_BYTES = 16 << 20
#: Ranges of an archive at most; larger archives have larger ranges.
MOST_RANGES = 64
#: Bytes of a directory that are held at once while it is walked.
WALK_BYTES = 1 << 20
#: Options that bound an archive, with those of uploads.
LIMITS = {"most_entries": MOST_ENTRIES, "most_entry_bytes": MOST_ENTRY_BYTES, "most_bytes": MOST_ARCHIVE_BYTES}
#: Unpacked bytes and entries of one Arrow batch.
BATCH_BYTES, BATCH_ENTRIES = 8 << 20, 1000


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("/"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def archives_in(location: str) -> list[str]:
    """The archive itself, or the archives right in a folder, in order of their names."""
    fs, path = filesystem(location)
    head = location[: len(location) - len(path)] if location.endswith(path) else ""
    if fs.get_file_info(path).type == pafs.FileType.File:
        return [location]
    found = fs.get_file_info(pafs.FileSelector(path))
    return [head + f.path for f in sorted(found, key=lambda f: f.path) if f.type == pafs.FileType.File and f.base_name.lower().endswith(".zip")]


@dataclass
class Range(InputPartition):
    """The bytes begin to end (not included) of an archive, a part of its directory with so many entries, or the problem for which none is read; offset is that of the directory as the archive states it."""

    archive: str
    start: int = 0
    offset: int = 0
    begin: int = 0
    end: int = 0
    entries: int = 0
    problem: str | None = None

    def __post_init__(self) -> None:
        super().__init__(None)


class Part(io.RawIOBase):
    """An archive as if its directory had the entries of a range only."""

    def __init__(self, f: pa.NativeFile, part: Range):
        self.f, self.start, self.at = f, part.start, 0
        listed = f.read_at(part.end - part.begin, part.begin)
        self.tail = listed + struct.pack("<4s4H2LH", b"PK\5\6", 0, 0, part.entries & 0xFFFF, part.entries & 0xFFFF, len(listed), part.offset, 0)

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.at

    def seek(self, to: int, whence: int = 0) -> int:
        self.at = max(0, to + (0, self.at, self.start + len(self.tail))[whence])
        return self.at

    def readinto(self, into) -> int:
        data = self.f.read_at(min(len(into), self.start - self.at), self.at) if self.at < self.start else self.tail[self.at - self.start : self.at - self.start + len(into)]
        into[: len(data)] = data
        self.at += len(data)
        return len(data)


def directory(f: pa.NativeFile) -> tuple[int, int, int]:
    """Where an archive's directory starts and ends, and the offset that the archive states for it."""
    size = f.size()
    tail_at = max(0, size - (1 << 16) - 98)
    tail = f.read_at(size - tail_at, tail_at)
    at = tail.rfind(b"PK\5\6")
    if at < 0 or at + 22 > len(tail):
        raise zipfile.BadZipFile("File is not a zip file")
    length, offset = struct.unpack_from("<2L", tail, at + 12)
    if at >= 76 and tail[at - 20 : at - 16] == b"PK\6\7" and tail[at - 76 : at - 72] == b"PK\6\6":
        length, offset = struct.unpack_from("<2Q", tail, at - 76 + 40)
        at -= 76
    end = tail_at + at
    if length > end or offset > end - length or offset >= 0xFFFFFFFF:
        raise zipfile.BadZipFile("Bad offset for central directory")
    return end - length, end, offset


def walk(f: pa.NativeFile, start: int, end: int) -> Iterator[tuple[int, int, str, int]]:
    """begin, end, name and unpacked size of each entry of a directory, in order."""
    at, base, data = start, start, b""
    while at < end:
        if at - base + 46 + 3 * 0xFFFF > len(data) and base + len(data) < end:
            base, data = at, f.read_at(min(WALK_BYTES, end - at), at)
        k = at - base
        if data[k : k + 4] != b"PK\1\2" or k + 46 > len(data):
            raise zipfile.BadZipFile("Bad magic number for central directory")
        flags, size, name, extra, comment = struct.unpack_from("<8xH14xL3H", data, k)
        if size == 0xFFFFFFFF and extra:  # of a large entry, in the first field of its own
            found = data[k + 46 + name : k + 46 + name + extra]
            while len(found) >= 12 and found[:2] != b"\1\0":
                found = found[4 + struct.unpack_from("<H", found, 2)[0] :]
            size = struct.unpack_from("<Q", found, 4)[0] if len(found) >= 12 else size
        last = at + 46 + name + extra + comment
        yield at, last, data[k + 46 : k + 46 + name].decode("utf-8" if flags & 0x800 else "cp437"), size
        at = last


@dataclass
class ArchiveReader(DataSourceReader):
    location: str
    range_bytes: int
    with_content: bool
    most_entries: float = MOST_ENTRIES
    most_entry_bytes: float = MOST_ENTRY_BYTES
    most_bytes: float = MOST_ARCHIVE_BYTES
    filters: list[Filter] = field(default_factory=list)

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Keeps what it can tell from an entry's name; Spark applies the rest."""
        for f in filters:
            if isinstance(f, EqualTo | In | StringStartsWith | StringEndsWith | StringContains) and f.attribute == ("path",):
                self.filters.append(f)
            else:
                yield f

    def _wanted(self, path: str) -> bool:
        tests = {EqualTo: lambda v: path == v, In: lambda v: path in v, StringStartsWith: path.startswith, StringEndsWith: path.endswith, StringContains: lambda v: v in path}
        return all(tests[type(f)](f.value) for f in self.filters)

    def partitions(self) -> list[Range]:
        out: list[Range] = []
        for archive in archives_in(self.location):
            fs, path = filesystem(archive)
            try:
                with fs.open_input_file(path) as f:
                    out += self._ranges(archive, f)
            except (zipfile.BadZipFile, OSError, ValueError, NotImplementedError, struct.error) as e:
                out.append(Range(archive, problem=str(e)))
        return out or [Range("")]

    def _ranges(self, archive: str, f: pa.NativeFile) -> list[Range]:
        start, end, offset = directory(f)
        n, total, largest, problem = 0, 0, 0, None
        for _, _, name, size in walk(f, start, end):
            if name.endswith("/"):
                continue
            problem = problem or entry_problem(name)
            n, total, largest = n + 1, total + size, max(largest, size)
            if n > self.most_entries:
                problem = "too many entries"
                break
        if n <= self.most_entries and (largest > self.most_entry_bytes or total > self.most_bytes):
            problem = "an entry or the whole is too large"
        if problem:
            return [Range(archive, problem=problem)]
        full = max(self.range_bytes, -(-(total + 64 * n) // MOST_RANGES))
        out, begin, held, entries = [], start, 0, 0
        for _, last, name, size in walk(f, start, end):
            entries += 1
            held += 0 if name.endswith("/") else size + 64
            if held >= full or last == end:
                out.append(Range(archive, start, offset, begin, last, entries))
                begin, held, entries = last, 0, 0
        return out

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("archive", pa.string()), ("path", pa.string()), ("size", pa.int64()), ("content", pa.binary()), ("problem", pa.string())])
        name = part.archive.rsplit("/", 1)[-1]
        if part.problem:
            if not self.filters:
                yield pa.RecordBatch.from_pylist([{"archive": name, "problem": part.problem}], schema=schema)
            return
        if not part.archive:
            return
        fs, path = filesystem(part.archive)
        rows, held = [], 0
        with fs.open_input_file(path) as f, zipfile.ZipFile(io.BufferedReader(Part(f, part))) as z:
            for i in (i for i in z.infolist() if not i.is_dir()):
                own = i.filename.replace("\\", "/")
                if not self._wanted(own):
                    continue
                content = None
                if self.with_content:
                    with z.open(i) as entry:
                        content = entry.read(i.file_size + 1)
                    if len(content) != i.file_size:
                        raise ValueError(f"{name}: {own} has not the size that the directory gives")
                rows.append({"archive": name, "path": own, "size": i.file_size, "content": content})
                held += i.file_size
                if held >= BATCH_BYTES or len(rows) >= BATCH_ENTRIES:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)


class ArchiveSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        options = self.options
        return ArchiveReader(options["path"], int(options.get("range_bytes", RANGE_BYTES)), str(options.get("content", "true")).lower() != "false", *(float(options.get(k, v)) for k, v in LIMITS.items()))


def read_large_archives(spark: SparkSession, location: str, range_bytes: int = RANGE_BYTES, content: bool = True, limited: bool = True) -> DataFrame:
    """archive (its name), path, size, content and problem of the entries of an archive, or of the archives in a folder; an archive that breaks a limit gives one row with the problem.

    limited=False reads archives of one's own, which may have any number of entries and bytes; names are checked all the same.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ArchiveSource)
    limits = {} if limited else dict.fromkeys(LIMITS, "inf")
    return spark.read.format("archive").options(range_bytes=range_bytes, content=str(content).lower(), **limits).load(location)
