"""Repositories as tables of files: directories, archives, stored tables, and checks of what is asked for."""

from __future__ import annotations

import atexit
import io
import re
import uuid
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from ..rules import any_of, when_chain

#: Limits of an archive.
MOST_ENTRIES, MOST_ENTRY_BYTES, MOST_ARCHIVE_BYTES, LEAST_ARCHIVE_BYTES = 10_000, 50 << 20, 200 << 20, 4
SIGNATURES = (b"PK\x03\x04", b"PK\x05\x06", b"PK\x07\x08")
SHELL = " \n\r;&|`$"
#: Where written tables lie if the session names no shared folder: one machine, as in tests.
LOCAL_SHARED = "file:///tmp/checkpoints/evgraph-tables"


def read_directory(spark: SparkSession, root: str, pattern: str | None = None) -> DataFrame:
    """path (relative), size, content, of every file below root; nothing is read before it is asked for."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    reader = reader.option("pathGlobFilter", pattern) if pattern else reader
    base = root.rstrip("/") + "/"
    bare = base.split(":", 1)[1] if ":" in base else base
    bare = "/" + bare.lstrip("/")
    relative = F.regexp_replace(F.regexp_replace("path", "^[A-Za-z]+:/*", "/"), "^" + re.escape(bare), "")
    return reader.load(root).select(relative.alias("path"), F.col("length").alias("size"), "content", "modificationTime")


def with_text(files: DataFrame) -> DataFrame:
    """content as UTF-8 text; bytes that aren't are replaced."""
    return files.withColumn("content", F.decode("content", "UTF-8"))


def url_problem(url: Column) -> Column:
    """What is wrong with a repository's address; null if nothing is."""
    u = F.trim(url)
    shell = any_of([u.contains(c) for c in SHELL])
    return when_chain(
        [
            (F.coalesce(u, F.lit("")) == "", "The address is empty."),
            (shell | u.startswith("-"), "The address has characters that aren't allowed."),
            (~u.rlike("(?i)^https?://"), "The address is not http or https."),
            (~u.rlike(r"(?i)^https?://[a-z0-9_.-]+(:[0-9]+)?/[a-z0-9_.%/-]+?(\.git)?/?$"), "The address is not a repository's."),
        ]
    )


def repository_name(url: Column) -> Column:
    path = F.rtrim(F.regexp_replace(url, "^[a-z]+://[^/]*", ""), F.lit("/"))
    return F.regexp_replace(paths.file_name(path), r"\.git$", "")


def archive_problem(content: Column, size: Column) -> Column:
    first = F.hex(F.substring(content, 1, 4))
    return when_chain(
        [
            (content.isNull(), "There is no archive."),
            (size == 0, "The archive is empty."),
            (size > MOST_ARCHIVE_BYTES, "The archive is too large."),
            (size < LEAST_ARCHIVE_BYTES, "The archive is too small."),
            (~first.isin(*(s.hex().upper() for s in SIGNATURES)), "The file is not a zip archive."),
        ]
    )


def entry_problem(name: str) -> str | None:
    """What is wrong with an entry's name: an entry may not leave the archive's folder."""
    name = name.replace("\\", "/")
    return "an entry leaves the archive's folder" if name.startswith("/") or ":" in name[:3] or ".." in name.split("/") else None


def read_archives(archives: DataFrame) -> DataFrame:
    """archive, path, size, content, problem of each file in the archives (path, content); limits hold while entries are read.

    An archive that breaks a limit gives one row with the problem and no files.
    """
    schema = pa.schema([("archive", pa.string()), ("path", pa.string()), ("size", pa.int64()), ("content", pa.binary()), ("problem", pa.string())])

    def entries(data: bytes) -> list[tuple]:
        total, out = 0, []
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            listed = [i for i in z.infolist() if not i.is_dir()]
            if len(listed) > MOST_ENTRIES:
                raise ValueError("too many entries")
            for i in listed:
                name = i.filename.replace("\\", "/")
                if problem := entry_problem(name):
                    raise ValueError(problem)
                with z.open(i) as f:
                    content = f.read(MOST_ENTRY_BYTES + 1)
                total += len(content)
                if len(content) > MOST_ENTRY_BYTES or total > MOST_ARCHIVE_BYTES:
                    raise ValueError("an entry or the whole is too large")
                out.append((name, len(content), content, None))
        return out

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                try:
                    rows = entries(data or b"")
                except (ValueError, zipfile.BadZipFile, RuntimeError, NotImplementedError) as e:
                    rows = [(None, None, None, str(e))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows)), *(pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), list(schema)[1:], strict=True))], schema=schema)

    return archives.select("path", "content").mapInArrow(read, "archive string, path string, size long, content binary, problem string")


class Refused(ValueError):
    """A request whose address or archive breaks a rule; its text says which."""


def checked(spark: SparkSession, problem: Column) -> None:
    found = spark.range(1).select(problem.alias("problem")).first()["problem"]
    if found:
        raise Refused(found)


def _repository(spark: SparkSession, request: dict) -> DataFrame:
    """The files of an address, once it is found to be allowed; cloned to the request's folder or a new one that executors share."""
    checked(spark, url_problem(F.lit(request["location"])))
    folder = request.get("folder") or f"{shared_root(spark)}/clone-{uuid.uuid4().hex}"
    if folder.startswith("file:"):
        folder = "/" + folder[5:].lstrip("/")
    return read_directory(spark, clone(request["location"].strip(), folder))


def _archive(spark: SparkSession, request: dict) -> DataFrame:
    """The files of an uploaded archive; raises with the problem of the archive or of an entry."""
    archives = spark.read.format("binaryFile").load(request["location"])
    first = archives.select(archive_problem(F.col("content"), F.col("length")).alias("problem")).where("problem IS NOT NULL").first()
    if first:
        raise Refused(first["problem"])
    from .archive_source import read_large_archives

    entries = settle(read_large_archives(spark, request["location"]), "archive")
    bad = entries.where("problem IS NOT NULL").select("problem").first()
    if bad:
        raise Refused(bad["problem"])
    return entries.select("path", "size", "content")


class Sources:
    """Repository sources by name: the first that can handle a request reads it."""

    def __init__(self) -> None:
        self.known: list[tuple[Callable[[dict], bool], Callable[[SparkSession, dict], DataFrame]]] = []
        self.add(lambda r: r.get("type") == "ZipUpload", _archive)
        self.add(lambda r: r.get("type") == "GitUrl", _repository)
        self.add(lambda r: r.get("type") == "Directory", lambda s, r: read_directory(s, r["location"]))

    def add(self, can: Callable[[dict], bool], read: Callable[[SparkSession, dict], DataFrame]) -> None:
        self.known.append((can, read))

    def read(self, spark: SparkSession, request: dict) -> DataFrame:
        for can, read in self.known:
            if can(request):
                return read(spark, request)
        raise ValueError(f"no source for {request.get('type')}")


def clone(url: str, folder: str, seconds: int = 120) -> str:
    """A shallow clone by git on the driver, into a folder that executors can read."""
    import subprocess

    subprocess.run(["git", "clone", "--depth", "1", "--no-tags", "--single-branch", "--", url, folder], check=True, timeout=seconds, capture_output=True)
    return folder


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; without it one on this machine, if the session runs on it alone."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return (found or LOCAL_SHARED).rstrip("/")


def _delete(spark: SparkSession, uri: str) -> None:
    try:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session has gone; the shared folder's owner clears it
        pass


def settle(df: DataFrame, tag: str) -> DataFrame:
    """Write to the folder that driver and executors share, and reread: lineage ends here, and a lost executor costs no rerun.

    The table lasts until release() or the driver's end.
    """
    spark = df.sparkSession
    path = scratch(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch(spark: SparkSession, tag: str) -> str:
    """A new folder's URI below the shared folder, deleted when the driver ends."""
    path = f"{shared_root(spark)}/{tag}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, path)
    return path


def release(*tables: DataFrame) -> None:
    """Delete the files of tables that settle() wrote, once nothing reads them any more."""
    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            _delete(df.sparkSession, folder)


def write_tables(tables: dict[str, DataFrame], root: str) -> None:
    """Each table as Parquet by analysis_id; the analyses written replace their own partitions and no others."""
    for name, df in tables.items():
        writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        (writer.partitionBy("analysis_id") if "analysis_id" in df.columns else writer).parquet(f"{root}/{name}")


def read_table(spark: SparkSession, root: str, name: str, analysis_id: str | None = None) -> DataFrame:
    """A stored table, of one analysis if one is named: only its folder is read."""
    df = spark.read.parquet(f"{root}/{name}")
    return df if analysis_id is None else df.where(F.col("analysis_id") == analysis_id)


def to_json(df: DataFrame) -> DataFrame:
    """Rows as JSON with camelCase names."""

    def camel(name: str) -> str:
        first, *rest = name.split("_")
        return first + "".join(x.capitalize() for x in rest)

    return df.select(F.to_json(F.struct(*(F.col(c).alias(camel(c)) for c in df.columns))).alias("json"))
